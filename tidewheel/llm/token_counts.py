"""Token counts: edit-aware counting with a segment tree of pre-token runs per document.

A document is cut where white space follows something else; no pre-token of the byte-level pattern spans such a cut, so
token counts of the parts add up. LEAF_CUTS parts make a leaf, and a binary tree over the leaves holds the sums of their
characters and tokens. An edit re-encodes the leaves it touches and, where it comes within a character of a leaf's end,
the neighbour too, since only there the boundary could change; sums are then renewed along the paths to the root.
Tokens of a pre-token are those of the byte-level BPE; each distinct pre-token is encoded once per worker, and at most
CACHE counts are kept.

`build_trees` counts texts once and gives each row its tree, as the sums of the leaves; written as a table, the trees are
kept beside their texts. `apply_edits` takes such a table with a column of edits (from a table of edits by `with_edits`, or
any other expression), encodes only what the edits touch, and gives the new texts, trees and counts, which can be kept and
edited again. `edit_counts` does both, over a table of trees in the shared folder. `redactions` gives the edits of the
registered query: long digit runs, addresses and hexadecimal secrets are masked and lines equal to an earlier one are
emptied.

Every step is a scan and a batched map; only with_edits joins. Edits are places in the text as it stands in the row; they
are applied from the last to the first, and cut to the text. A null or empty text has 0 tokens and one empty leaf; edited, a
null text counts as empty. Repeated rows are counted one by one; an empty table gives an empty result; extra columns stay,
but one named like an output, in whatever case, is replaced by it.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, column, free_name, materialize, others, slices, text_bytes

LEAF_CUTS = 32
CACHE = 300_000
RANKS = "byte_bpe_50k.tiktoken"
_CUT = re.compile(r"(?<=\S)(?=\s)")
Edit = tuple[int, int, str]


class PieceCounter:
    """Tokens of texts, by pre-token."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = CACHE):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.cache, self.known = cache, {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(known) < self.cache:  # the pre-tokens that came first are the common ones, and stay
                    known[piece] = n
            total += n
        return total


_counters: dict[tuple[str, str], PieceCounter] = {}


def counter_of(ranks_path: str, pattern: str) -> PieceCounter:
    """The worker's counter; Spark reuses workers, and so the pre-tokens of earlier tasks are known."""
    if (ranks_path, pattern) not in _counters:
        _counters[ranks_path, pattern] = PieceCounter(ranks_path, pattern)
    return _counters[ranks_path, pattern]


class TokenTree:
    """Leaves of a text with sums of characters and tokens; node 1 is the root."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_cuts: int = LEAF_CUTS, kept: tuple[list[int], list[int]] | None = None):
        """kept: the leaves' characters and tokens, of a tree that was built before; then nothing is encoded."""
        self.count = count
        if kept is None:
            cuts = [m.start() for m in _CUT.finditer(text)][leaf_cuts - 1 :: leaf_cuts]
            bounds = [0, *cuts, len(text)]
        else:
            bounds = list(itertools.accumulate(kept[0], initial=0))
            if bounds[-1] != len(text):
                raise ValueError("the tree is not of this text")
        self.leaves = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        self.room = 1
        while self.room < len(self.leaves):
            self.room *= 2
        self.chars, self.tokens = [0] * (2 * self.room), [0] * (2 * self.room)
        self.chars[self.room : self.room + len(self.leaves)] = map(len, self.leaves)
        self.tokens[self.room : self.room + len(self.leaves)] = kept[1] if kept is not None else map(count, self.leaves)
        for i in range(self.room - 1, 0, -1):
            self._renew(i)
        self.reencoded = 0

    def kept(self) -> tuple[list[int], list[int]]:
        """The leaves' characters and tokens, without emptied leaves."""
        rows = [(c, t) for c, t in zip(self.chars[self.room :], self.tokens[self.room :]) if c] or [(0, 0)]
        return [c for c, _ in rows], [t for _, t in rows]

    def _renew(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf with the character at place."""
        node, start = 1, 0
        while node < self.room:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.room, start

    def apply(self, start: int, end: int, new: str) -> None:
        """Replaces the characters start to end of the text as it is now."""
        size = self.chars[1]
        start, end = max(0, min(start, size)), max(0, min(end, size))
        if not size:
            self._set(0, new)
            self._paths([0])
            return
        first, at = self._leaf_at(max(0, min(start - 1, size - 1)))
        last, last_at = self._leaf_at(min(size - 1, end + 1))
        region = "".join(self.leaves[first : last + 1])
        self._set(first, region[: start - at] + new + region[end - at :])
        for i in range(first + 1, last + 1):
            self.leaves[i] = ""
            self.chars[self.room + i] = self.tokens[self.room + i] = 0
        self._paths(range(first, last + 1))

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.reencoded += len(text)
        self.chars[self.room + leaf], self.tokens[self.room + leaf] = len(text), self.count(text)

    def _paths(self, leaves) -> None:
        nodes = {(self.room + i) // 2 for i in leaves} - {0}
        while nodes:
            for i in nodes:
                self._renew(i)
            nodes = {i // 2 for i in nodes if i > 1}

    def apply_all(self, edits: list[Edit]) -> None:
        """Edits in places of the original text, without overlap; the last comes first, so places stay valid."""
        for start, end, new in sorted(edits, reverse=True):
            self.apply(start, end, new)


_MASKED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-f]{32,}|[\w.+-]+@[\w-]+\.[\w.]+|[0-9]{5,}")


def redactions(text: str) -> list[Edit]:
    """The query's edits: masks for numbers, addresses and secrets; repeated lines are emptied."""
    edits: list[Edit] = []
    seen, at = set(), 0
    for line in text.split("\n"):
        if line in seen and line.strip():
            edits.append((at, at + len(line), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "[masked]") for m in _MASKED.finditer(line)]
        at += len(line) + 1
    return edits


TREE = "chars array<int>, tokens array<int>, n_tokens long"
EDITS = "array<struct<start:int,end:int,new:string>>"
COUNTS = ("n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")


def _tree_array(trees: list[TokenTree]) -> pa.Array:
    kept = [t.kept() for t in trees]
    columns = [pa.array([k[i] for k in kept], pa.list_(pa.int32())) for i in (0, 1)]
    return pa.StructArray.from_arrays([*columns, pa.array([t.total for t in trees], pa.int64())], names=["chars", "tokens", "n_tokens"])


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_tree", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with a struct column `out`: the leaves' chars and tokens, and n_tokens."""
    fields = others(docs, [out], keep)
    schema = T.StructType([*fields, T.StructField(out, T.StructType.fromDDL(TREE))])
    frame, places = carried(docs, text, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                trees = [TokenTree((t or b"").decode(), count) for t in text_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [_tree_array(trees)], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def with_edits(trees: DataFrame, edits: DataFrame, doc_id: str = "doc_id", out: str = "edits") -> DataFrame:
    """trees with the column `out` of a table of edits (doc_id, start, end, new). Edits of a null id are ignored."""
    key = free_name("edited_id", [*trees.columns, out])
    grouped = edits.where(column(doc_id).isNotNull()).groupBy(column(doc_id).alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).cast(EDITS).alias(out))
    kept = [column(f.name) for f in others(trees, [out])]
    return trees.select(*kept).join(grouped, column(doc_id) == column(key), "left").drop(key)


def with_redactions(docs: DataFrame, text: str = "text", out: str = "edits", edits: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """docs with the column `out`: the edits that a function of the text asks for."""
    fields = others(docs, [out])
    schema = T.StructType([*fields, T.StructField(out, T._parse_datatype_string(EDITS))])
    frame, places = carried(docs, text, fields)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[{"start": a, "end": b, "new": n} for a, b, n in edits((t or b"").decode())] for t in text_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + [pa.array(found, kind)], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def apply_edits(
    trees: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    tree: str = "token_tree",
    edits: str = "edits",
    out: str = "token_counts",
    keep: list[str] | None = None,
) -> DataFrame:
    """trees (or its columns `keep`), with the text and the tree after the edits and a struct column `out`: n_tokens (before),
    n_edits, n_tokens_edited and n_reencoded, the characters that the edits encoded anew."""
    fields = others(trees, [out, edits], keep)
    schema = T.StructType([*fields, T.StructField(out, T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))])
    names = [text, tree, edits, *[f.name for f in fields if f.name not in (text, tree)]]
    frame, places = trees.select(*[column(n).alias(f"c{i}") for i, n in enumerate(names)]), [names.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                rows, made, texts = [], [], []
                for t, kept, changes in zip(text_bytes(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    one = TokenTree((t or b"").decode(), count, kept=(kept["chars"], kept["tokens"]))
                    before, changes = one.total, [(e["start"], e["end"], e["new"] or "") for e in changes or ()]
                    one.apply_all(changes)
                    rows.append((before, len(changes), one.total, one.reencoded))
                    made.append(one)
                    texts.append(one.text() if changes else None if t is None else t.decode())
                columns = zip(*rows) if rows else [()] * len(COUNTS)
                struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))
                new = {0: lambda: pa.array(texts, pa.string()), 1: lambda: _tree_array(made)}
                yield pa.RecordBatch.from_arrays([new[i]() if i in new else part.column(i) for i in places] + [struct], names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def edit_counts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    edits: Callable[[str], list[Edit]] = redactions,
    text: str = "text",
    keep: list[str] | None = None,
    out: str = "token_counts",
) -> DataFrame:
    """docs (or its columns `keep`), texts as edited, with the struct column `out` of apply_edits: trees are built, kept as a
    table in the shared folder, and edited."""
    fields = [f.name for f in others(docs, [out], keep)]
    tree, changes = (free_name(n, [*docs.columns, out]) for n in ("token_tree", "edits"))
    needed = [*fields, *([] if text in fields else [text])]
    kept = materialize(build_trees(docs.select(*map(column, needed)), ranks_path, pattern, text, tree), "trees")
    return apply_edits(with_redactions(kept, text, changes, edits), ranks_path, pattern, text, tree, changes, out, fields)
