"""Enhanced suffix arrays of bounded sets of byte strings and their common-prefix interval trees."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes) -> int:
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class SuffixArray:
    """Suffixes in order, the common prefix of each with the one before, and the bytes to the left of each, reversed.

    The suffixes may be all of some texts or only those that start at certain places (a sparse suffix array).
    """

    def __init__(self, suffixes: list[bytes], lefts: list[bytes]) -> None:
        self.order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        self.suffixes, self.lefts = suffixes, lefts
        own = [suffixes[i] for i in self.order]
        self.lcp = [0, *map(common_prefix, own, own[1:])]

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix, first, end) of each inner node of the interval tree, children first, by one scan with a stack."""
        stack = [(0, 0)]
        for i in range(1, len(self.order) + 1):
            here, first = (self.lcp[i] if i < len(self.order) else -1), i - 1
            while stack and stack[-1][0] > here:
                depth, first = stack.pop()
                yield depth, first, i
            if not stack or stack[-1][0] < here:
                stack.append((here, first))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, list[int]]]:
        """(bytes to the left, bytes to the right, all members) of each repeat of `least` bytes that neither side can extend.

        An inner node's members share its common prefix. Their left sides, sorted, have common prefixes themselves, and a
        stack scan of those gives the parts of the node that share `left` bytes to the left. A part counts if its left
        extensions are diverse and its members don't all go on alike to the right (a part may share more than its node).
        """
        for depth, first, end in self.intervals():
            members = sorted(self.order[first:end], key=self.lefts.__getitem__)
            own = [self.lefts[i] for i in members]
            if depth + max(map(len, own)) < least:
                continue
            shared = [0, *map(common_prefix, own, own[1:])]
            stack, at = [(0, 0)], len(members)
            for k in range(1, at + 1):
                here, start = (shared[k] if k < at else -1), k - 1
                while stack and stack[-1][0] > here:
                    left, start = stack.pop()
                    group = members[start:k]
                    if left + depth >= least and diverse(self.lefts, group, left) and diverse(self.suffixes, group, depth):
                        yield left, depth, sorted(group)
                if not stack or stack[-1][0] < here:
                    stack.append((here, start))


def diverse(sides: list[bytes], group: list[int], shared: int) -> bool:
    """Whether a group's members differ behind the bytes they share on one side; an end differs from everything."""
    after = {sides[i][shared : shared + 1] for i in group}
    return len(after) > 1 or b"" in after


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all (text, start)) of every string of at least `least` bytes that occurs twice or more and is maximal.

    Over all suffixes of a bounded set of texts; the byte before a suffix (or the text's begin, which differs from
    everything) tests the diversity of its left extensions.
    """
    places = [(t, s) for t, text in enumerate(texts) for s in range(len(text) - least + 1)]
    array = SuffixArray([texts[t][s:] for t, s in places], [b""] * len(places))
    out = []
    for depth, first, end in array.intervals():
        if depth >= least:
            members = [places[i] for i in array.order[first:end]]
            before = {texts[t][s - 1] if s else (t,) for t, s in members}
            if len(before) > 1 or any(s == 0 for _, s in members):
                out.append((depth, sorted(members)))
    return out
