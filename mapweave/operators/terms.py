"""Many terms in many texts: one pass over a text for all cards or rules of a block, whatever their number.

Cards and rules are dimension tables of any size. They are cut into blocks of a bounded number of characters; a block goes to
the tasks with its function, which builds one automaton there and walks each text once. Results of blocks are put together
by Spark: scores are merged and sorted, and of rules the first block in priority order that has a hit decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa

from mapweave.functions.memory import release

#: Characters of the terms in one block; its automaton takes some 60 bytes for each.
BLOCK_CHARS = 2_000_000
#: Rows that are looked at together: of more the words and scores are not held as Python objects at once.
ROWS = 500
TOKEN = re.compile(r"[a-zA-Z0-9_-]{2,}")
NUMBER = re.compile(r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])")
#: Signs that match i, s and k when case is ignored, but stay themselves in lower case.
ALIKE = {0x131: "i", 0x17F: "s", 0x212A: "k"}


def blocks(items: list, chars: Callable[[object], int], limit: int) -> Iterator[list]:
    """items in order, in runs of at most `limit` characters."""
    block, size = [], 0
    for x in items:
        n = chars(x)
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append(x)
        size += n
    if block:
        yield block


def in_parts(fn: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """fn over ROWS rows at a time; then freed memory goes back to the system."""
    out = pa.concat_arrays([fn(texts.slice(at, ROWS)) for at in range(0, max(1, len(texts)), ROWS)])
    release()
    return out


class Terms:
    """Numbers of the terms that a text contains."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.automaton = None

    def add(self, term: str) -> int:
        return self.number.setdefault(term, len(self.number))

    def __getstate__(self):
        return {"number": self.number, "automaton": None}

    def found(self, text: str) -> set[int]:
        if self.automaton is None:
            import ahocorasick
            self.automaton = ahocorasick.Automaton()
            for term, n in self.number.items():
                if term:
                    self.automaton.add_word(term, n)
            if len(self.automaton):
                self.automaton.make_automaton()
        out = {n for _, n in self.automaton.iter(text)} if len(self.automaton) and text else set()
        if "" in self.number:
            out.add(self.number[""])
        return out


class Scores:
    """Scores of a block of cards: weights of the terms in a text, of shared words, of the card's number and of rules.

    A card is (place, category, number, terms [(term, weight)], words); a rule is (number, positives, vetoes, boost) and holds
    for the cards of its number.
    """

    def __init__(self, cards: list[tuple], rules: list[tuple], word_weight: float, number_weight: float, stop: list[str], most: float, least: int | None) -> None:
        self.terms, self.by_term, self.by_word, self.by_number = Terms(), defaultdict(list), defaultdict(list), defaultdict(list)
        self.category, self.size, self.stop = {}, {}, set(stop)
        self.word_weight, self.number_weight, self.most, self.least = word_weight, number_weight, most, least
        for place, category, number, terms, words in cards:
            self.category[place], self.size[place] = category, len(words)
            for term, weight in terms:
                self.by_term[self.terms.add(term)].append((place, weight))
            for w in words:
                self.by_word[w].append(place)
            if number:
                self.by_number[number].append(place)
        self.rules = [({self.terms.add(x) for x in yes}, {self.terms.add(x) for x in no}, boost, self.by_number[number]) for number, yes, no, boost in rules if number in self.by_number]

    def of(self, low: str) -> list[tuple[float, int]]:
        """(score, place) in falling order: all above 0, and of the others the first ones, so that there are `least` (None: all)."""
        score, shared = defaultdict(float), defaultdict(int)
        found = self.terms.found(low)
        for n in found:
            for place, weight in self.by_term.get(n, ()):
                score[place] += weight
        words = set(TOKEN.findall(low)) - self.stop
        for w in words:
            for place in self.by_word.get(w, ()):
                shared[place] += 1
        for place, n in shared.items():
            score[place] += self.word_weight * n / max(len(words) + self.size[place] - n, 1)
        for number in set(NUMBER.findall(low)):
            for place in self.by_number.get(number, ()):
                score[place] += self.number_weight
        for yes, no, boost, places in self.rules:
            if not yes.isdisjoint(found) and no.isdisjoint(found):
                for place in places:
                    score[place] += boost
        out = sorted((-round(min(self.most, s), 9), place) for place, s in score.items() if round(s, 9) > 0)
        wanted = len(self.category) if self.least is None else min(self.least, len(self.category))
        if len(out) < wanted:
            have = {place for _, place in out}
            rest = (place for place in self.category if place not in have)
            out += [(-0.0, next(rest)) for _ in range(wanted - len(out))]
        return [(-s, place) for s, place in out]

    def __call__(self, low: pa.Array) -> pa.Array:
        return in_parts(self.scored, low)

    def scored(self, low: pa.Array) -> pa.Array:
        rows = [self.of(t or "") for t in low.to_pylist()]
        flat = [x for r in rows for x in r]
        offsets, at = [0], 0
        for r in rows:
            at += len(r)
            offsets.append(at)
        entries = pa.StructArray.from_arrays([pa.array([-s for s, _ in flat], pa.float64()), pa.array([p for _, p in flat], pa.int32()), pa.array([self.category[p] for _, p in flat], pa.string())], names=["k", "i", "category"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def fragment(pattern: str) -> str:
    """Letters and digits that every match of a regular expression holds in a row, in lower case; "" where none is sure.

    Groups, alternatives, classes and counted repetitions are not looked into.
    """
    plain = re.sub(r"\\[dDwWsSbBAZ\W]", " ", pattern)
    if re.search(r"[|()\[\]{}\\]", plain):
        return ""
    return max(re.findall(r"(?:[A-Za-z0-9](?![?*]))+", plain), key=len, default="").lower()


class Rules:
    """The first rule of a block whose pattern matches its context.

    A rule is (context, mode, pattern), patterns of other modes than regex in folded case. Contexts are numbered columns.
    Texts are searched for all contained patterns and fragments at once; a regular expression is tried only where its
    fragment is found, and exact patterns are looked up.
    """

    def __init__(self, rules: list[tuple[int, str, str]], contexts: int) -> None:
        self.rules, self.contexts = rules, contexts
        self.index = None

    def __getstate__(self):
        return {"rules": self.rules, "contexts": self.contexts, "index": None}

    def built(self):
        if self.index is None:
            self.index = [(Terms(), defaultdict(list), {}, Terms(), defaultdict(list), []) for _ in range(self.contexts)]
            for place, (context, mode, pattern) in enumerate(self.rules):
                contained, by_term, exact, parts, by_part, always = self.index[context]
                try:
                    search = re.compile(pattern, re.IGNORECASE).search if mode == "regex" else None
                except (re.error, OverflowError, RecursionError):
                    search, pattern = None, pattern.casefold()  # an unreadable pattern is taken literally
                if search:
                    part = fragment(pattern)
                    (by_part[parts.add(part)] if part else always).append((place, search))
                elif mode == "exact":
                    exact.setdefault(pattern.strip(), place)
                else:
                    by_term[contained.add(pattern)].append(place)
        return self.index

    def first(self, texts: tuple[str, ...]) -> int | None:
        best = len(self.rules)
        for text, (contained, by_term, exact, parts, by_part, always) in zip(texts, self.built()):
            best = min(best, exact.get(text.strip(), best), *(by_term[n][0] for n in contained.found(text)))
            tried = always + [x for n in (parts.found(text.translate(ALIKE)) if by_part else ()) for x in by_part[n]]
            for place, search in sorted(tried, key=lambda x: x[0]):
                if place >= best:
                    break
                if search(text):
                    best = place
        return best if best < len(self.rules) else None

    def __call__(self, *texts: pa.Array) -> pa.Array:
        return pa.array([self.first(tuple(t or "" for t in row)) for row in zip(*(x.to_pylist() for x in texts))], pa.int32())
