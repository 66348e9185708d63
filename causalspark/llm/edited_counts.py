"""Edit-aware token counts: a segment tree of pre-token counts per document, of which an edit touches a few leaves.

A text is cut into stretches that no token crosses (white space, then other characters). Leaves hold some of them with
their characters and tokens; inner nodes hold the sums. An edit (start, end, replacement) goes down the tree to the
stretches it touches, takes one more on either side as context, cuts and encodes that region again, and adds the
differences along the path to the root. The token count of the whole text is then the root's sum.

Edits are applied in the order given, each to the text that the edits before have left, with code-point offsets.

Defined cases: null and empty texts have no tokens and accept insertions; offsets beyond the text are moved to its end,
an end before its start is its start; a null edit list or replacement is empty; a null doc_id stays null; repeated rows
give repeated results; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import map_rows
from causalspark.llm.segments import BYTE_BPE, BYTE_BPE_CUT as CUT, Segments, byte_bpe, once

#: Stretches in a leaf when the tree is built.
LEAF = 32


def counter(path: str = BYTE_BPE) -> Segments:
    """stretch -> number of tokens, remembered; one per Python worker."""
    def make():
        coding = byte_bpe(path)
        return Segments(lambda s: len(coding.encode_ordinary(s)))
    return once(("counter", path), make)


class CountTree:
    """The pre-tokens of one text under a segment tree of character and token sums."""

    def __init__(self, text: str, count: Segments):
        self.count, self.encoded = count, 0
        self._build(CUT(text))

    def _build(self, stretches: list[str]) -> None:
        count = self.count
        self.leaves = [stretches[i:i + LEAF] for i in range(0, len(stretches), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(map(len, leaf))
            self.tokens[self.size + i] = sum(map(count.__getitem__, leaf))
        for node in range(self.size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(s for leaf in self.leaves for s in leaf)

    def _find(self, offset: int) -> tuple[int, int, int]:
        """Leaf, stretch in it, and start of the stretch that holds the character at ``offset`` (the last one, at the end)."""
        node, at = 1, 0
        while node < self.size:
            node *= 2
            if offset >= at + self.chars[node] and self.chars[node + 1]:
                at += self.chars[node]
                node += 1
        leaf = node - self.size
        if leaf >= len(self.leaves):
            return len(self.leaves) - 1, 0, at
        last = max(0, len(self.leaves[leaf]) - 1)
        for i, stretch in enumerate(self.leaves[leaf]):
            if offset < at + len(stretch) or i == last:
                return leaf, i, at
            at += len(stretch)
        return leaf, 0, at

    def _set(self, leaf: int, stretches: list[str]) -> None:
        old, new = self.leaves[leaf], stretches
        self.leaves[leaf] = new
        chars = sum(map(len, new)) - sum(map(len, old))
        tokens = sum(map(self.count.__getitem__, new)) - sum(map(self.count.__getitem__, old))
        node = leaf + self.size
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node >>= 1

    def edit(self, start: int, end: int, replacement: str) -> None:
        n = self.n_chars
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        first, i, at = self._find(start)
        if at > 0:  # the stretch before, as context
            first, i, at = self._find(at - 1)
        last, j, stop = self._find(max(end - 1, start))
        if self.leaves[last]:
            stop += len(self.leaves[last][j])
        if stop < n:  # the stretch after, as context
            last, j, stop = self._find(stop)
            stop += len(self.leaves[last][j])
        touched = []
        for leaf in range(first, last + 1):
            row = self.leaves[leaf]
            touched += row[i if leaf == first else 0:j + 1 if leaf == last else len(row)]
        region = "".join(touched)
        region = region[:start - at] + replacement + region[end - at:]
        self.encoded += len(region)
        row = self.leaves[first][:i] + CUT(region) + self.leaves[last][j + 1:]
        if len(row) > 8 * LEAF * (last - first + 1):  # much was inserted here: build anew, once for many insertions
            self._build([s for leaf in [*self.leaves[:first], row, *self.leaves[last + 1:]] for s in leaf])
            return
        share = -(-len(row) // (last - first + 1))  # spread evenly, so that no leaf gathers its neighbours' stretches
        for k, leaf in enumerate(range(first, last + 1)):
            self._set(leaf, row[k * share:(k + 1) * share])


def repeated_line_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that drop each line that occurred before in the text, and shorten runs of one punctuation mark to the mark."""
    edits, seen, at, moved = [], set(), 0, 0
    for line in text.splitlines(keepends=True):
        if line.strip() and line in seen:
            edits.append((at - moved, at - moved + len(line), ""))
            moved += len(line)
        else:
            seen.add(line)
            for m in re.finditer(r"([!#$%&*|])\1+", line):
                edits.append((at + m.start() - moved, at + m.end() - moved, m[1]))
                moved += m.end() - m.start() - 1
        at += len(line)
    return edits


def edited_counts(docs: DataFrame, edits=repeated_line_edits, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """doc_id, n_tokens, n_chars, n_edits, n_tokens_after, n_chars_after, n_encoded (characters encoded again).

    ``edits`` is a function of the text, or the name of a column array<struct<start, end, replacement>>.
    """
    made = callable(edits)

    def make():
        count = counter(tokenizer)

        def step(columns):
            out = []
            for i, text in enumerate(columns[1]):
                tree = CountTree(text, count)
                row = [tree.n_tokens, tree.n_chars]
                todo = edits(text) if made else [(e["start"], e["end"], e["replacement"] or "") for e in columns[2][i] or []]
                for start, end, replacement in todo:
                    tree.edit(start, end, replacement)
                out.append([*row, len(todo), tree.n_tokens, tree.n_chars, tree.encoded])
            return [columns[0], *map(list, zip(*out, strict=True))]
        return step
    columns = [F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    if not made:
        columns.append(F.expr(f"transform(`{edits}`, e -> named_struct('start', coalesce(e.start, 0), 'end', coalesce(e.end, 0), 'replacement', e.replacement))"))
    return map_rows(docs.select(*columns), make, "doc_id bigint, n_tokens bigint, n_chars bigint, n_edits bigint, n_tokens_after bigint, n_chars_after bigint, n_encoded bigint")
