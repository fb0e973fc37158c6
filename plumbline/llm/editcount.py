"""Token counts that follow edits.

A document keeps its pre-tokens as leaves of a tree of sums: each leaf has a
length in code points and a number of tokens, each inner node the sums of its
children.  An edit finds its place by descending the tree, cuts and encodes the
touched region anew with a little context on its left and until the old
boundaries are met again on its right, and repairs the sums above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from . import pretoken

FAN = 32


class CountTree:
    """Pre-tokens of one text: blocks of up to 2 * FAN leaves below levels of sums with FAN children a node."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.blocks = [(lengths[i : i + FAN], counts[i : i + FAN]) for i in range(0, len(lengths), FAN)] or [([], [])]
        self._sum_up()

    def _sum_up(self) -> None:
        self.levels = [[(sum(a), sum(b)) for a, b in self.blocks]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([(sum(x[0] for x in low[i : i + FAN]), sum(x[1] for x in low[i : i + FAN])) for i in range(0, len(low), FAN)])

    @property
    def length(self) -> int:
        return self.levels[-1][0][0]

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, start) of the leaf that holds code point at; the last leaf if at is the end."""
        node, start = 0, 0
        for level in range(len(self.levels) - 2, -1, -1):
            child, last = node * FAN, min(node * FAN + FAN, len(self.levels[level])) - 1
            while child < last and start + self.levels[level][child][0] <= at:
                start += self.levels[level][child][0]
                child += 1
            node = child
        lengths = self.blocks[node][0]
        leaf = 0
        while leaf < len(lengths) - 1 and start + lengths[leaf] <= at:
            start += lengths[leaf]
            leaf += 1
        return node, leaf, start

    def replace(self, first: tuple[int, int], end: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put leaves in place of those from first up to, without, end; both are (block, leaf)."""
        (b0, l0), (b1, l1) = first, end
        own = ([*self.blocks[b0][0][:l0], *lengths, *self.blocks[b1][0][l1:]], [*self.blocks[b0][1][:l0], *counts, *self.blocks[b1][1][l1:]])
        if b0 == b1 and 0 < len(own[0]) <= 2 * FAN:
            self.blocks[b0] = own
            dn, dt, node = sum(own[0]) - self.levels[0][b0][0], sum(own[1]) - self.levels[0][b0][1], b0
            for level in self.levels:  # the path to the root
                level[node] = (level[node][0] + dn, level[node][1] + dt)
                node //= FAN
            return
        new = [(own[0][i : i + FAN], own[1][i : i + FAN]) for i in range(0, len(own[0]), FAN)]
        self.blocks[b0 : b1 + 1] = new
        if not self.blocks:
            self.blocks, new = [([], [])], [([], [])]
        self.levels[0][b0 : b1 + 1] = [(sum(a), sum(b)) for a, b in new]
        self._repair(b0, len(new) == b1 + 1 - b0, b0 + len(new))

    def _repair(self, first: int, in_place: bool, end: int) -> None:
        """Inner sums anew from node `first` of the lowest level on; up to `end` alone where no node has moved."""
        k = 0
        while len(self.levels[k]) > 1:
            low = self.levels[k]
            first, end = first // FAN, -(-end // FAN)
            if k + 1 == len(self.levels):
                self.levels.append([])
                first, in_place = 0, False
            up = self.levels[k + 1]
            stop = end if in_place else -(-len(low) // FAN)
            up[first : stop if in_place else len(up)] = [(sum(x[0] for x in low[i * FAN : i * FAN + FAN]), sum(x[1] for x in low[i * FAN : i * FAN + FAN])) for i in range(first, stop)]
            k += 1
        del self.levels[k + 1 :]


def apply_edit(text: str, tree: CountTree, start: int, end: int, new: str, pattern, count) -> tuple[str, int]:
    """(the edited text, how many pre-tokens were encoded anew); tree follows.

    text[start:end] becomes new.  Cutting is left to right and looks at most one
    run of white space ahead, so it restarts two pre-tokens before the edit and
    stops where a new boundary behind the edit falls on an old one.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    edited = text[:start] + new + text[end:]
    shift = len(edited) - len(text)
    block, leaf, at = tree.find(max(start - 1, 0))
    for _ in range(2):
        if leaf:
            leaf -= 1
        elif block:
            block -= 1
            leaf = len(tree.blocks[block][0]) - 1
        else:
            break
        at -= tree.blocks[block][0][leaf]
    first, old = (block, leaf), at
    lengths, counts, new_at = [], [], at
    stop = start + len(new)
    for m in pattern.finditer(edited, at):
        if new_at >= stop + 1:
            while old + shift < new_at and block < len(tree.blocks):
                if leaf < len(tree.blocks[block][0]):
                    old += tree.blocks[block][0][leaf]
                    leaf += 1
                else:
                    block, leaf = block + 1, 0
            if old + shift == new_at and old >= end:
                break
        lengths.append(len(m[0]))
        counts.append(count(m[0]))
        new_at = m.end()
    else:
        block, leaf = len(tree.blocks) - 1, len(tree.blocks[-1][0])
    if block >= len(tree.blocks):
        block, leaf = len(tree.blocks) - 1, len(tree.blocks[-1][0])
    tree.replace(first, (block, leaf), lengths, counts)
    return edited, len(lengths)


TREE = "struct<lengths:array<int>,counts:array<int>>"


def count_edits(docs: DataFrame, edits: str = "edits", vocabulary: str | None = None, tree: str | None = None, keep: bool = False, most_cached: int = 500_000) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_pretokens, tokens_after, pretokens_after, n_reencoded and edited_chars.

    docs: doc_id, text and the column `edits`, an array of (start, end, new):
    each replaces text[start:end], in code points of the text as the edits
    before it left it; bounds outside the text are drawn in.  A null text is
    empty, null edits and null parts of one change nothing.

    keep: adds text_after and tree_after, the leaves of the edited text's tree.
    tree: names a column of such trees of the texts as they are; where it is not
    null the text is not cut and encoded again, so edits can go on from batch to
    batch.  Other columns of docs are ignored, whatever their names.  Rows are
    worked on one by one, in place, repeated ones alike; an empty table gives no
    rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_pretokens", "tokens_after", "pretokens_after", "n_reencoded", "edited_chars"]
    more = ["text_after", "tree_after"] * keep
    leaves = pa.struct([("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        import public_tokenizers

        encoder = pretoken.default_encoder(vocabulary)
        pattern = regex.compile(public_tokenizers.PATTERN)
        seen: dict[str, int] = {}

        def count(piece: str) -> int:
            n = seen.get(piece)
            if n is None:
                if len(seen) >= most_cached:
                    seen.clear()
                n = seen[piece] = len(encoder.whole.encode_ordinary(piece))
            return n

        def cut(data, off):
            """(text, lengths, counts) of each text."""
            if len(data) and data.max() < 0xC9:
                text = data.tobytes().decode()
                cp, at, starts, owner, entry = encoder.pretokens(data, off)
                n = encoder.count[entry].tolist()
                size = np.diff(np.append(starts, len(cp))).tolist()
                first = np.searchsorted(owner, np.arange(len(off))).tolist()
                at = at.tolist()
                return [(text[at[i] : at[i + 1]], size[first[i] : first[i + 1]], n[first[i] : first[i + 1]]) for i in range(len(off) - 1)]
            out = []
            for i in range(len(off) - 1):
                own = data[off[i] : off[i + 1]].tobytes().decode()
                pieces = pattern.findall(own)
                out.append((own, list(map(len, pieces)), list(map(count, pieces))))
            return out

        for batch in batches:
            todo, known = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, data, off in B.chunks(batch.column(1)):
                if all(k is not None for k in known[lo:hi]):
                    whole = [(data[off[i] : off[i + 1]].tobytes().decode(), known[lo + i]["lengths"], known[lo + i]["counts"]) for i in range(hi - lo)]
                else:
                    whole = [(t, *((a, b) if k is None else (k["lengths"], k["counts"]))) for (t, a, b), k in zip(cut(data, off), known[lo:hi])]
                rows, after = [], []
                for own, lengths, counts in whole:
                    own_tree = CountTree(lengths, counts)
                    before, anew, now = (own_tree.tokens, len(lengths)), 0, own
                    for e in todo[lo + len(rows)] or ():
                        if e is not None and None not in (e["start"], e["end"], e["new"]):
                            now, k = apply_edit(now, own_tree, e["start"], e["end"], e["new"], pattern, count)
                            anew += k
                    rows.append((*before, own_tree.tokens, sum(len(b[0]) for b in own_tree.blocks), anew, len(now)))
                    if keep:
                        after.append((now, {"lengths": [x for b in own_tree.blocks for x in b[0]], "counts": [x for b in own_tree.blocks for x in b[1]]}))
                cols = [pa.array(x, pa.int64()) for x in zip(*rows)]
                if keep:
                    cols += [pa.array([x[0] for x in after], pa.string()), pa.array([x[1] for x in after], leaves)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=names + more)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + f", text_after string, tree_after {TREE}" * keep
    given = (F.col(tree) if tree else F.lit(None)).cast(TREE)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(edits).cast("array<struct<start:long,end:long,new:string>>").alias("edits"), given.alias("tree")).mapInArrow(run, schema)
