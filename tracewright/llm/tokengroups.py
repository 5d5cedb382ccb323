"""Operator 11: exact n-gram Jaccard join of documents by a token-group matrix.

A document's set holds its distinct 4-word shingles (A-Z lower-cased; the whole sequence with fewer words). Documents with equal
sets are one node. Nodes are partitioned into groups of similar ones by the least shingle hash, which two sets share with the
probability of their similarity; least hashes that very many nodes share are split, so a group is bounded. The token-group matrix
holds a column for each group, its token union, and travels by rows: a range of tokens with the columns' parts of it learns in
how many groups each token is.

A set at 85 % of a query holds one of any 15 % + 1 of the query's tokens, so the rarest of them (in the order of groups that hold them,
then of hashes, which is one order for all) show which groups can hold partners. Tokens that no other group holds lead nowhere, which ends the search for
nearly all documents inside their own group. For the others a group qualifies by the tokens shown, by its sizes and, where it is met,
by the overlap of the query with its union; qualifying groups alone are opened and their members compared on full sets.

Classes are wanted, not pairs: a group whose members with the shown tokens are in the query's class already is not opened, and
of tokens that many groups hold first a pivot is compared with one node of each class, so a family of copies over many groups is
joined before groups are opened for each of its members. No pair that could join two classes is left out.

Null and blank texts have an empty set: n_shingles 0, linked with nothing. Rows with equal sets (repeated rows too) are linked;
rows of one doc_id with different texts have a component_id each; a null doc_id becomes one only where its whole component has none.
Extra columns are left out; an empty table gives an empty result. A long text is as large as its set and is a group's member whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, drop, partitions, release
from .components import add_edges, label
from .neardup import shingle_sets

SHINGLE, PERCENT = 4, 85
#: Shingles of a group, tokens of a range of the matrix, and shingles of one least hash from which on it is split.
GROUP, RANGE, SPLIT = 600_000, 1_000_000, 80_000


def least_overlap(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that any set at ``percent`` shares with it, at least."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node (16-byte digest of the set, null if empty), low (least hash), text_key per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, node, low = [], [], []
            for items in shingle_sets(b.column(1), shingle):
                n.append(len(items))
                node.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                low.append(items[0].astype(np.int64) if len(items) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(low, pa.int64()), b.column(2)], ["doc_id", "n_shingles", "node", "low", "text_key"])
        release()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, low long, text_key long")


def grouped(nodes: DataFrame, groups: int) -> DataFrame:
    """``nodes`` (node, low, n) with pid: equal least hashes are in one group, but parts of those with too many shingles."""
    crowded = nodes.groupBy("low").agg(F.sum("n").alias("w")).where(F.col("w") > SPLIT).select("low", F.ceil(F.col("w") / SPLIT).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0))
    return nodes.join(crowded, "low", "left").withColumn("pid", F.pmod(F.xxhash64("low", part), F.lit(groups))).drop("low", "parts")


# --- the matrix --------------------------------------------------------------------------------


def union_of(sets: list[np.ndarray]) -> np.ndarray:
    """A group's column: its distinct tokens, by their upper 48 bits."""
    return np.unique(np.concatenate([s >> U64(16) for s in sets])) if sets else np.zeros(0, U64)


def ranges_of(column: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of a column's sorted tokens; a range is the tokens' upper ``bits``."""
    at = (column >> U64(48 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)][: len(first)], strict=True))


def packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def columns(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """range, pid, blob: each group's token union, cut into ranges."""

    def run(t: pa.Table) -> pa.Table:
        pid, column = t["pid"][0].as_py(), union_of(list(shingle_sets(t["text"], shingle)))
        parts = ranges_of(column, bits)
        release()
        return pa.table({"range": pa.array([p[0] for p in parts], pa.int64()), "pid": pa.array([pid] * len(parts), pa.int64()), "blob": pa.array([packed(column[a:b]) for _, a, b in parts], pa.binary())})

    return texts.groupBy("pid").applyInArrow(run, "range long, pid long, blob binary")


def held_by(matrix: DataFrame) -> DataFrame:
    """range, pid, blob: for each token of a column's part the groups that hold it, as 0 for one group, else one plus the
    whole logarithm to base 2."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpacked(b) for b in t["blob"].to_pylist()]
        tokens = np.concatenate(parts)
        order = np.argsort(tokens, kind="stable")
        first = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[0]] ^ U64(1)))
        held = np.diff(np.append(first, len(tokens)))
        code = np.where(held > 1, np.floor(np.log2(held)) + 1, 0).astype(np.uint8)
        said = np.empty(len(tokens), np.uint8)
        said[order] = np.repeat(code, held)
        ends = np.cumsum([len(p) for p in parts])
        out = pa.table({"range": t["range"], "pid": t["pid"], "blob": pa.array([said[e - len(p) : e].tobytes() for p, e in zip(parts, ends.tolist(), strict=True)], pa.binary())})
        release()
        return out

    return matrix.groupBy("range").applyInArrow(run, "range long, pid long, blob binary")


# --- inside a group ----------------------------------------------------------------------------


class Sets:
    """Sets of a group, to be compared with one set at a time, and their classes as they merge."""

    def __init__(self, sets: list[np.ndarray], classes: np.ndarray, percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        self.union, coded = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.cumsum(self.size)
        self.items = [coded[e - n : e] for e, n in zip(at.tolist(), self.size.tolist(), strict=True)]
        self.classes, self.mark = classes.copy(), np.zeros(len(self.union), bool)

    def similar(self, items: np.ndarray, n: int, among: np.ndarray) -> np.ndarray:
        """Of ``among`` those similar to a set of ``n`` tokens, of which ``items`` (places in the union) are in the union."""
        among = among[100 * np.minimum(self.size[among], n) >= self.percent * np.maximum(self.size[among], n)]
        if not len(among):
            return among
        self.mark[items] = True
        sizes = self.size[among]
        both = np.add.reduceat(self.mark[np.concatenate([self.items[k] for k in among.tolist()])], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[items] = False
        return among[100 * both >= self.percent * (n + sizes - both)]

    def merge(self, into: int, found: np.ndarray) -> None:
        gone = np.unique(self.classes[found])
        self.classes[np.isin(self.classes, gone)] = into


def shown(sets: list[np.ndarray], column: np.ndarray, codes: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each set its rarest tokens, as many as show every partner, and the codes of these."""
    out = []
    for s in sets:
        code = codes[np.searchsorted(column, s >> U64(16))]
        first = np.lexsort((s, code))[: len(s) - least_overlap(len(s), percent) + 1]
        out.append((s[first], code[first]))
    return out


def classes_within(sets: list[np.ndarray], prefixes: list[np.ndarray], percent: int) -> np.ndarray:
    """The class of each set of a group (the least place in it), by comparing sets that show a common token."""
    n = len(sets)
    work = Sets(sets, np.arange(n), percent)
    token, of = np.concatenate(prefixes), np.repeat(np.arange(n), [len(p) for p in prefixes])
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(first, len(token)))
    lists = [of[a : a + c] for a, c in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True)]
    mine: list[list[int]] = [[] for _ in range(n)]
    degree = np.zeros(n, np.int64)
    for k, members in enumerate(lists):
        degree[members] += len(members)
        for m in members.tolist():
            mine[m].append(k)
    closed, done = np.zeros(len(lists), bool), np.zeros(n, bool)
    # the set that shows most of what others show comes first: it is likely to join a whole family at once
    for q in np.argsort(-degree, kind="stable").tolist():
        if not mine[q]:
            continue
        own, met = work.classes[q], []
        for k in mine[q]:
            if not closed[k]:
                other = work.classes[lists[k]] != own
                if other.any():
                    met.append(lists[k][other])
                else:
                    closed[k] = True
        done[q] = True
        if met:
            among = np.unique(np.concatenate(met))
            found = work.similar(work.items[q], len(sets[q]), among[~done[among]])
            if len(found):
                work.merge(min(own, int(work.classes[found].min())), np.append(found, q))
    return work.classes


def members(texts: DataFrame, answers: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, pid, n, root (a node of its class within the group), tokens (shown ones that other groups hold) and payload
    (the set, if there are such tokens) of the nodes that have such tokens or are not alone."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        node = t["node"].to_pylist()
        first = {x: k for k, x in enumerate(node)}
        keep = sorted(first.values())
        every = list(shingle_sets(t["text"], shingle))
        sets, node = [every[k] for k in keep], [node[k] for k in keep]
        column = union_of(sets)
        codes = np.frombuffer(b"".join(told.sort_by("range")["blob"].to_pylist()), np.uint8)
        rarest = shown(sets, column, codes, percent)
        classes = classes_within(sets, [p for p, _ in rarest], percent)
        least: dict[int, bytes] = {}
        for k, c in enumerate(classes.tolist()):
            least[c] = min(least.get(c, node[k]), node[k])
        alone = np.bincount(classes, minlength=len(sets)) == 1
        rows = []
        for k, (p, code) in enumerate(rarest):
            open_tokens = p[code > 0].view(np.int64)
            if len(open_tokens) or not alone[classes[k]]:
                rows.append((node[k], len(sets[k]), least[classes[k]], open_tokens, sets[k].tobytes() if len(open_tokens) else None))
        out = pa.table({"node": pa.array([r[0] for r in rows], pa.binary()), "pid": pa.array([t["pid"][0].as_py()] * len(rows), pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "root": pa.array([r[2] for r in rows], pa.binary()), "tokens": pa.array([r[3] for r in rows], pa.list_(pa.int64())), "payload": pa.array([r[4] for r in rows], pa.binary())})
        release()
        return out

    return texts.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(run, "node binary, pid long, n long, root binary, tokens array<bigint>, payload binary")


# --- between groups ----------------------------------------------------------------------------


def fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def still_open(tokens: DataFrame, roots: DataFrame | None) -> DataFrame:
    """token, node, pid, n, root of the tokens that nodes of two classes or more show."""
    rows = label(tokens, roots, "node", "root")
    two = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return cut(rows.join(two, "token"), "open-tokens")


def by_pivots(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each token's pivot, the node that shows most open tokens, with a node of each other class."""
    degree = rows.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    of = rows.join(degree, "node")
    each = of.groupBy("token", "root").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("r"), F.max("degree").alias("degree"))
    best = each.groupBy("token").agg(F.max_by(F.struct("r.node", "r.n", "root"), F.struct("degree", "root")).alias("p"))
    met = each.join(best, "token").where("root <> p.root").where(fits("r.n", "p.n", percent))
    pairs = met.select(F.col("p.node").alias("a"), F.col("r.node").alias("b")).distinct()
    left, right = (sets.select(F.col("node").alias(c), F.col("payload").alias(f"of_{c}")) for c in ("a", "b"))

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def by_groups(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of queries with members of other groups: the matrix rows of the open tokens say which groups a query may
    open; where the query meets a group the overlap with the group's union decides.

    Two groups meet once: a query goes to groups of greater numbers. The queries of a group are dealt into shares of bounded size."""
    entries = rows.groupBy("token", F.col("pid").alias("to")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = rows.join(entries, "token").where("pid < to and not (lo = root and hi = root)")
    met = met.where((F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent)).select("node", "to", "n", "root").distinct()
    asked = cut(met, "qualifying-groups")
    shares = asked.groupBy("to").agg(F.ceil(F.sum("n") / GROUP).alias("shares"))
    queries = asked.join(shares, "to").join(sets, "node").select("to", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"), "node", "root", "payload")
    current = rows.select("node", F.col("pid").alias("to"), "root").distinct().join(shares, "to").join(sets, "node")
    group = current.select(F.col("to").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"), F.col("node").alias("member"), F.col("root").alias("its_root"), F.col("payload").alias("its_set"))

    def run(q: pa.Table, g: pa.Table) -> pa.Table:
        links: list[tuple[bytes, bytes]] = []
        if q.num_rows and g.num_rows:
            known = {r: k for k, r in enumerate(dict.fromkeys(g["its_root"].to_pylist() + q["root"].to_pylist()))}
            node = g["member"].to_pylist()
            work = Sets([np.frombuffer(x, U64) for x in g["its_set"].to_pylist()], np.array([known[r] for r in g["its_root"].to_pylist()]), percent)
            now, least = np.arange(len(known)), int(work.size.min())
            for name, root, blob in zip(q["node"].to_pylist(), q["root"].to_pylist(), q["payload"].to_pylist(), strict=True):
                items = np.frombuffer(blob, U64)
                at = np.minimum(np.searchsorted(work.union, items), len(work.union) - 1)
                inside = at[work.union[at] == items]
                # the bound: whoever is similar shares this much with the query, and so does the union
                if len(inside) < max(least_overlap(len(items), percent), least_overlap(least, percent)):
                    continue
                own = now[known[root]]
                found = work.similar(inside, len(items), np.flatnonzero(now[work.classes] != own))
                for c in np.unique(now[work.classes[found]]).tolist() if len(found) else []:
                    k = int(found[now[work.classes[found]] == c][0])
                    links.append((name, node[k]))
                    now[now == c] = own
        release()
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return queries.groupBy("to", "share").cogroup(group.groupBy("of", "part")).applyInArrow(run, "a binary, b binary")


def join_classes(found: DataFrame, percent: int) -> DataFrame | None:
    """node, root of the nodes of ``found`` (see ``members``) that are in one class with others."""
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = None if edges.isEmpty() else cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), "roots")
    tokens = found.where(F.size("tokens") > 0).select("node", "pid", "n", F.explode("tokens").alias("token"))
    sets = found.where("payload is not null").select("node", "payload")
    for links_of in (by_pivots, by_groups):
        rows = still_open(tokens, roots)
        if not rows.isEmpty():
            links = cut(links_of(rows, sets, percent), "links")
            if not links.isEmpty():
                old, roots = roots, cut(add_edges(roots, links), "roots")
                drop(old)
            drop(links)
        drop(rows)
    return roots


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id per row of ``docs``."""
    rows = cut(signatures(docs, shingle), "signatures")
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_key", "doc_id").alias("text_key"), F.first("n_shingles").alias("n"), F.first("low").alias("low")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, -(-total // RANGE) - 1).bit_length()
    placed = grouped(nodes, max(1, -(-total // GROUP)))
    held = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d").join(placed.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key")))
    texts = held.select("p.pid", "p.node", "d.text").repartition(partitions(docs.sparkSession), "pid")
    found = cut(members(texts, held_by(columns(texts, shingle, bits)), shingle, percent), "members")
    roots = join_classes(found, percent)
    # the smallest document of each class, by way of the nodes
    owned = label(nodes.select("node", "doc_id"), roots, "node", "root")
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(owned.join(least, "root").select("node", "component_id"), "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def digests(docs: DataFrame) -> DataFrame:
    return similar_documents(docs).drop("text_key")
