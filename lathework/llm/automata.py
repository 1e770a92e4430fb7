"""A vocabulary trie and its intersection with Levenshtein automata."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator


class Trie:
    """Words by their letters; :meth:`within` finds all words within an edit distance."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, query: str, most: int, drawn: Callable[[str], str] | None = None) -> Iterator[tuple[str, int]]:
        """Every (word, distance) with distance at most ``most``.

        The automaton's state is the row of edit distances of the letters read so
        far to all beginnings of the query; a branch ends where all exceed ``most``.
        With ``drawn``, what a letter is drawn like, it also ends where the letters are not drawn like the query.
        """
        n = len(query)
        shape = "".join(map(drawn, query)) if drawn else ""
        stack = [(self.root, tuple(range(n + 1)), 0)]
        while stack:
            node, row, at = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[n] <= most and at == len(shape):
                        yield below, row[n]
                    continue
                to = at
                if drawn:
                    like = drawn(c)
                    if not shape.startswith(like, at):
                        continue
                    to += len(like)
                best = step = row[0] + 1
                new = [step]
                for j in range(n):
                    step = min(step + 1, row[j + 1] + 1, row[j] + (query[j] != c))
                    new.append(step)
                    if step < best:
                        best = step
                if best <= most:
                    stack.append((below, tuple(new), to))
