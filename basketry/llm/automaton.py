"""A lexicon trie walked together with Levenshtein automata.

A state is the set of (trie node, edits so far) a word may be in. States are made when a word first needs them and remembered,
so matching a word is one table look-up per letter; most words fall out of the trie after a few letters. A term is a whole word or a
stem; a stem ends the walk wherever it is complete.
"""

from __future__ import annotations

OTHER = ""


class Lexicon:
    """Terms (text, is_stem) with up to one edit for terms of `long` letters or more."""

    def __init__(self, terms: list[tuple[str, bool]], long: int = 5, states: int = 50_000):
        self.terms, self.long, self.bound = terms, long, states
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[bool] = [False]  # a term long enough for an edit lies at or below
        for number, (term, _) in enumerate(terms):
            node = 0
            self.reach[0] |= len(term) >= long
            for letter in term:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.reach.append(False)
                node = self.child[node][letter]
                self.reach[node] |= len(term) >= long
            self.ends[node].append(number)
        self.letters = {letter for term, _ in terms for letter in term}
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.whole: list[tuple | None] = []
        self.stem: list[tuple | None] = []
        self.start = self.state({(0, 0)})

    def state(self, places: set) -> int:
        # a letter of the term left out of the word costs an edit
        closed = dict.fromkeys(places)
        for node, edits in list(closed):
            if not edits:
                for below in self.child[node].values():
                    if self.reach[below]:
                        closed[below, 1] = None
        key = frozenset(p for p in closed if p[1] == 0 or (p[0], 0) not in closed)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = sorted((edits, number) for node, edits in key for number in self.ends[node] if not edits or len(self.terms[number][0]) >= self.long)
            self.whole.append(next(((n, e) for e, n in ends if not self.terms[n][1]), None))
            self.stem.append(next(((n, e) for e, n in ends if self.terms[n][1]), None))
        return self.number[key]

    def after(self, state: int, letter: str) -> int:
        places = set()
        for node, edits in self.sets[state]:
            below = self.child[node].get(letter)
            if below is not None:
                places.add((below, edits))
            if not edits and self.reach[node]:
                places.add((node, 1))  # a letter too many
                places.update((x, 1) for x in self.child[node].values() if self.reach[x])  # another letter
        return self.state(places) if places else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match, fewest edits first."""
        if len(self.sets) > self.bound:
            self.reset()
        state, best = self.start, None
        step = self.step
        for letter in word:
            if letter not in self.letters:
                letter = OTHER
            found = step[state].get(letter)
            if found is None:
                found = step[state][letter] = self.after(state, letter)
            if found < 0:
                return best
            state = found
            hit = self.stem[state]
            if hit is not None and (best is None or hit[1] < best[1]):
                best = hit
                if not hit[1]:
                    return best
        hit = self.whole[state]
        return hit if hit is not None and (best is None or hit[1] < best[1]) else best
