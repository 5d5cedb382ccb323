"""Recall of the line links of operator 1 against all pairs: python -m tests.llm.measure_recall [folder of tables].

Every pair of distinct lines at PERCENT or more is found by comparing all of them; lost are those that the operator leaves in
different components."""

import sys

import numpy as np

from tracewright.llm import linededup
from tracewright.llm.linking import BINS, may_be_near, sketch


def all_links(lines):
    sets = linededup.shingle_sets(lines)
    size = np.array(list(map(len, sets)))
    _, items = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark, found = np.zeros(items.max() + 1, bool), []
    for p in range(len(lines)):
        mark[items[at[p] : at[p + 1]]] = True
        both = np.add.reduceat(mark[items], at[:-1], dtype=np.int64)
        mark[items[at[p] : at[p + 1]]] = False
        found += [(p, q) for q in np.flatnonzero(both * (100 + linededup.PERCENT) >= linededup.PERCENT * (size + size[p])).tolist() if q > p]
    return sets, found


def recall(lines):
    """Links, those that share a band, those that pass the sketch too, and those left in different components."""
    sets, links = all_links(lines)
    keys = linededup.band_keys(lines)
    marks = np.array([np.frombuffer(sketch(s), np.uint8) for s in sets]).reshape(-1, BINS)
    a, b = np.array(links).reshape(-1, 2).T
    shared = (keys[a] == keys[b]).any(1)
    near = may_be_near(marks[a].T.copy(), marks[b].T.copy(), linededup.PERCENT)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q, ok in zip(a.tolist(), b.tolist(), (shared & near).tolist()):
        if ok:
            root[find(p)] = find(q)
    lost = sum(find(p) != find(q) for p, q in zip(a.tolist(), b.tolist()))
    return len(links), int(shared.sum()), int((shared & near).sum()), lost


def main(folder):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = sorted({x for t in texts for x in linededup.normal_lines(t) if x})
    print("{} lines, {} links, {} share a band, {} of these pass the sketch, {} left in different components".format(len(lines), *recall(lines)))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
