"""Token counts that follow edits: a segment tree per document, of which only touched regions are encoded again.

The leaves of a tree are stretches of about ``LEAF`` characters whose counts add up to the count of the text.  They end

* at a firm cut: between two characters where the vocabulary's pre-tokenizer ends a piece whatever stands around them (before white
  space, and where letters, digits and other signs meet, but for an apostrophe before a letter), or beside the added token; or
* inside a long piece, such as thousands of letters without a blank, between two of its tokens.  Byte-pair merges of a piece are
  right if each two neighbouring tokens are what the two of them together encode to, so a cut of this kind is kept or found
  after an edit by encoding the two tokens beside it.

Inner nodes hold sums of characters, tokens and leaves.  The tree is balanced: finding a place, taking out leaves and putting in
others touch a logarithmic number of nodes.

An edit (start, removed, inserted) counts in characters of the text as the edits before it left it.  It touches the leaves
that it overlaps, and their neighbours while the cut between them holds no longer.  That region alone is cut and encoded again.

Defined cases: a null text counts as empty, with 0 tokens; a start or length beyond the text is cut to it; a null edit, start,
length or insertion counts as none, 0 and empty; repeated rows are counted each for itself; other columns stay as they are,
but for those named like the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.tokens import ADDED, TokenIds

LEAF = 256
#: Unicode's White_Space, as the pre-tokenizer's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FIRM = regex.compile(rf"{regex.escape(ADDED)}|(?s:.)(?={regex.escape(ADDED)})|[^{SPACE}](?=[{SPACE}])|\p{{L}}(?=[^{SPACE}\p{{L}}])|\p{{N}}(?=[^{SPACE}\p{{N}}])|[^{SPACE}\p{{L}}\p{{N}}'](?=[\p{{L}}\p{{N}}])|'(?=\p{{N}})")
_SAME = regex.compile(rf"[{SPACE}]{{2}}|\p{{L}}{{2}}|\p{{N}}{{2}}|[^{SPACE}\p{{L}}\p{{N}}]{{2}}")
# an apostrophe that a letter follows may begin a contraction once nothing stands before it
_SIGNS = regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]{{2}}(?<!'(?=\p{{L}}))")

TREE = "struct<n_chars:int,n_tokens:int,leaf_chars:array<int>,leaf_tokens:array<int>,leaf_first:array<int>,leaf_last:array<int>,node_left:array<int>,node_chars:array<int>,node_tokens:array<int>>"


class Node(NamedTuple):
    """A leaf has no sides, but the ids of its first and last token."""

    chars: int
    tokens: int
    leaves: int = 1
    height: int = 0
    left: Node | None = None
    right: Node | None = None
    first: int = -1
    last: int = -1


def _join(left: Node, right: Node) -> Node:
    return Node(left.chars + right.chars, left.tokens + right.tokens, left.leaves + right.leaves, 1 + max(left.height, right.height), left, right)


def _balanced(left: Node, right: Node) -> Node:
    """Joins two trees whose heights differ by two at most."""
    if left.height > right.height + 1:
        a, b = left.left, left.right
        return _join(a, _join(b, right)) if a.height >= b.height else _join(_join(a, b.left), _join(b.right, right))
    if right.height > left.height + 1:
        a, b = right.left, right.right
        return _join(_join(left, a), b) if b.height >= a.height else _join(_join(left, a.left), _join(a.right, b))
    return _join(left, right)


def concat(left: Node | None, right: Node | None) -> Node | None:
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _balanced(left.left, concat(left.right, right))
    if right.height > left.height + 1:
        return _balanced(concat(left, right.left), right.right)
    return _join(left, right)


def split(node: Node | None, n: int) -> tuple[Node | None, Node | None]:
    """The first ``n`` leaves and the others."""
    if node is None or n <= 0:
        return None, node
    if n >= node.leaves:
        return node, None
    if n < node.left.leaves:
        a, b = split(node.left, n)
        return a, concat(b, node.right)
    a, b = split(node.right, n - node.left.leaves)
    return concat(node.left, a), b


def built(leaves: list[Node]) -> Node | None:
    """A balanced tree over leaves."""
    while len(leaves) > 1:
        pairs = [_join(a, b) for a, b in zip(leaves[::2], leaves[1::2])]
        if len(leaves) % 2:  # the odd one goes with the last pair
            pairs[-1] = concat(pairs[-1], leaves[-1])
        leaves = pairs
    return leaves[0] if leaves else None


def firm(text: str, at: int) -> bool:
    """Whether a text may be cut at a place whatever its tokens are."""
    if at <= 0 or at >= len(text) or text.startswith(ADDED, at) or text.startswith(ADDED, at - len(ADDED)):
        return True
    return bool(_FIRM.match(text, at - 1)) and not inside_added(text, at)


def inside_added(text: str, at: int) -> bool:
    n = len(ADDED)
    return ADDED in text[max(0, at - n + 1) : at + n - 1]


class Counter:
    """Cuts and encodes texts, and keeps count of the characters that it encoded."""

    def __init__(self, ids: TokenIds):
        self.encode, self.encoding, self.chars = ids.encode, ids.encoding, 0

    def leaf(self, text: str) -> Node:
        self.chars += len(text)
        ids = self.encode(text)
        return Node(len(text), len(ids), first=ids[0], last=ids[-1])

    def parted(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when they meet inside a piece."""
        both = self.encoding.decode_single_token_bytes(left) + self.encoding.decode_single_token_bytes(right)
        return self.encoding._encode_single_piece(both) == [left, right]

    def may_part(self, text: str, at: int, left: int, right: int) -> bool:
        """Whether a place inside a piece of a text is a cut, its tokens beside it being these."""
        same = _SIGNS.match(text, at - 1) or (_SAME.match(text, at - 1) and "'" not in text[max(0, at - 3) : at + 3])
        return bool(same) and not inside_added(text, at) and self.parted(left, right)

    def leaves(self, text: str) -> list[Node]:
        """The leaves of a text that is a whole one, or stands between cuts."""
        out, at = [], 0
        while at < len(text):
            m = _FIRM.search(text, at + LEAF - 1)
            while m and inside_added(text, m.end()):
                m = _FIRM.search(text, m.end())
            end = m.end() if m else len(text)
            out += [self.leaf(text[at:end])] if end - at <= 2 * LEAF else self.long(text[at:end])
            at = end
        return out

    def long(self, text: str) -> list[Node]:
        """The leaves of a long stretch without a firm cut, parted between tokens."""
        self.chars += len(text)
        ids, found, begin, at, size, chars = self.encode(text), [], 0, 0, 0, 0
        parts = [self.encoding.decode_single_token_bytes(token) for token in ids]
        for i, token in enumerate(ids[:-1]):
            chars += sum(b & 0xC0 != 0x80 for b in parts[i])
            size += 1
            end = at + chars
            whole = parts[i + 1][0] & 0xC0 != 0x80  # the next token begins a character
            if whole and chars >= LEAF and len(text) - end >= LEAF // 4 and self.may_part(text, end, token, ids[i + 1]):
                found.append(Node(chars, size, first=ids[begin], last=token))
                begin, at, size, chars = i + 1, end, 0, 0
        found.append(Node(len(text) - at, size + 1, first=ids[begin], last=ids[-1]))
        return found


class Tree:
    """The segment tree of one text."""

    def __init__(self, root: Node | None):
        self.root = root

    n_chars = property(lambda self: self.root.chars if self.root else 0)
    n_tokens = property(lambda self: self.root.tokens if self.root else 0)

    @staticmethod
    def over(text: str, count: Counter) -> Tree:
        return Tree(built(count.leaves(text)))

    def find(self, at: int) -> tuple[int, int]:
        """Number and first character of the leaf that holds character ``at``; the last leaf for the text's end."""
        node, number, start = self.root, 0, 0
        while node.left is not None:
            if at < start + node.left.chars:
                node = node.left
            else:
                number, start, node = number + node.left.leaves, start + node.left.chars, node.right
        return number, start

    def leaf(self, number: int) -> Node:
        node = self.root
        while node.left is not None:
            if number < node.left.leaves:
                node = node.left
            else:
                number, node = number - node.left.leaves, node.right
        return node

    def edit(self, text: str, start: int, removed: int, inserted: str, count: Counter) -> tuple[str, int]:
        """The text after the edit, and how many characters were encoded again."""
        start = max(0, min(start, len(text)))
        stop = max(start, min(start + max(0, removed), len(text)))
        new, before = text[:start] + inserted + text[stop:], count.chars
        if not self.root:
            self.root = built(count.leaves(new))
            return new, count.chars - before
        (i, lo), (j, hi) = self.find(start), self.find(max(start, stop - 1))
        hi += self.leaf(j).chars
        grown = len(new) - len(text)
        while True:
            # outwards while a cut can hold neither firmly nor between tokens
            if lo >= hi + grown and (lo > 0 or hi < len(text)):
                left, right = lo > 0, lo <= 0
            else:
                left, right = lo > 0 and not firm(new, lo) and not _SAME.match(new, lo - 1), hi < len(text) and not firm(new, hi + grown) and not _SAME.match(new, hi + grown - 1)
            if not (left or right):
                again = count.leaves(new[lo : hi + grown])
                left = bool(again) and lo > 0 and not firm(new, lo) and not count.may_part(new, lo, self.leaf(i - 1).last, again[0].first)
                right = bool(again) and hi < len(text) and not firm(new, hi + grown) and not count.may_part(new, hi + grown, again[-1].last, self.leaf(j + 1).first)
                if not (left or right):
                    break
            if left:
                i -= 1
                lo -= self.leaf(i).chars
            if right:
                j += 1
                hi += self.leaf(j).chars
        kept, rest = split(self.root, i)
        self.root = concat(concat(kept, built(again)), split(rest, j - i + 1)[1])
        return new, count.chars - before

    def row(self) -> tuple:
        """The leaves in order and the inner nodes, each before its two sides."""
        leaves, inner, todo = [], [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node.left is None:
                leaves.append(node)
            else:
                inner.append(node)
                todo += [node.right, node.left]
        own = [[x.chars for x in leaves], [x.tokens for x in leaves], [x.first for x in leaves], [x.last for x in leaves]]
        return self.n_chars, self.n_tokens, *own, [x.left.leaves for x in inner], [x.chars for x in inner], [x.tokens for x in inner]

    @staticmethod
    def of_row(n_chars: int, n_tokens: int, leaf_chars, leaf_tokens, leaf_first, leaf_last, node_left, node_chars, node_tokens) -> Tree:
        leaves = [Node(int(c), int(t), first=int(a), last=int(b)) for c, t, a, b in zip(leaf_chars, leaf_tokens, leaf_first, leaf_last, strict=True)]
        at = 0

        def side(begin: int, end: int) -> Node:
            nonlocal at
            if end - begin == 1:
                return leaves[begin]
            k, at = at, at + 1
            left = side(begin, begin + int(node_left[k]))
            right = side(begin + int(node_left[k]), end)
            return Node(int(node_chars[k]), int(node_tokens[k]), end - begin, 1 + max(left.height, right.height), left, right)

        return Tree(side(0, len(leaves)) if leaves else None)


_FIELDS = ["n_chars", "n_tokens", "leaf_chars", "leaf_tokens", "leaf_first", "leaf_last", "node_left", "node_chars", "node_tokens"]


def tree_of(text: Column, vocabulary: str | None = None) -> Column:
    """The segment tree of a whole text."""

    @F.pandas_udf(TREE)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = Counter(TokenIds(vocabulary))
        for texts in batches:
            yield pd.DataFrame([Tree.over(t or "", count).row() for t in texts], columns=_FIELDS)

    return build.asNondeterministic()(text)


def after_edits(text: Column, tree: Column, edits: Column, vocabulary: str | None = None) -> Column:
    """``edits``: array of struct (start, removed, inserted), in order -> struct (tree, chars_encoded)."""

    @F.pandas_udf(f"struct<tree:{TREE},chars_encoded:long>")
    def recount(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = Counter(TokenIds(vocabulary))
        for texts, trees, edit_lists in batches:
            out = []
            for text, row, edits_ in zip(texts, trees[_FIELDS].itertuples(index=False), edit_lists, strict=True):
                own, now, encoded = Tree.of_row(*row), text or "", 0
                for e in edits_ if edits_ is not None else ():
                    if e is not None:
                        now, n = own.edit(now, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", count)
                        encoded += n
                out.append((dict(zip(_FIELDS, own.row(), strict=True)), encoded))
            yield pd.DataFrame(out, columns=["tree", "chars_encoded"])

    return recount.asNondeterministic()(text, tree, edits)


def counted(df: DataFrame, text: str = "text", tree: str = "tree", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the segment tree of its text column."""
    return in_small_batches(df).withColumn(tree, tree_of(F.col(f"`{text}`"), vocabulary))


def recounted(df: DataFrame, edits: str = "edits", text: str = "text", tree: str = "tree", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``tree_after`` and ``chars_encoded``: its trees after the edits of each row."""
    out = in_small_batches(df).withColumn("__after", after_edits(F.col(f"`{text}`"), F.col(tree), F.col(edits), vocabulary))
    return out.withColumn("tree_after", F.col("__after.tree")).withColumn("chars_encoded", F.col("__after.chars_encoded")).drop("__after")


def derived_edits(doc_id: Column, text: Column, n: int = 2, longest: int = 40) -> Column:
    """Edits of a document from its own text: at hashed places, up to ``longest`` characters go and as many come."""
    size = F.coalesce(F.length(text), F.lit(0))

    def place(k: int, part: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id, size, F.lit(k), F.lit(part)), below).cast("int")

    def one(k: int) -> Column:
        inserted = F.coalesce(F.substring(text, place(k, 1, size + 1) + 1, place(k, 2, F.lit(longest))), F.lit(""))
        return F.struct(place(k, 0, size + 1).alias("start"), place(k, 3, F.lit(longest)).alias("removed"), inserted.alias("inserted"))

    return F.array(*map(one, range(n)))
