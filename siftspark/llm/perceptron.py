"""An averaged-perceptron character editor: for every character keep, replace, delete, or insert after."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

KEEP = None
MISSED = 0.001  # of the edits trained on


def align(seen: str, true: str) -> list[str | None]:
    """For every seen character the text it stands for; None where it is kept, '' where it is deleted.

    What differs between the common beginning and end goes to the first differing character, the others of
    it being deleted; a text that only lacks characters gets them after the one before.
    """
    head = 0
    while head < min(len(seen), len(true)) and seen[head] == true[head]:
        head += 1
    tail = 0
    while tail < min(len(seen), len(true)) - head and seen[-1 - tail] == true[-1 - tail]:
        tail += 1
    out: list[str | None] = [KEEP] * len(seen)
    was, now = seen[head : len(seen) - tail], true[head : len(true) - tail]
    if was:
        out[head : head + len(was)] = [now, *[""] * (len(was) - 1)]
    elif now and head:
        out[head - 1] = seen[head - 1] + now
    elif now and seen:
        out[0] = now + seen[0]
    return out


def features(word: str, i: int) -> list[str]:
    c, low = word[i], word.lower()
    a = low[i - 1] if i else "^"
    b = low[i + 1] if i + 1 < len(low) else "$"
    aa = low[i - 2] if i > 1 else "^"
    bb = low[i + 2] if i + 2 < len(low) else "$"
    kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"
    return [f"c{c}", f"p{a}{c}", f"n{c}{b}", f"t{a}{c}{b}", f"q{aa}{a}{c}", f"r{c}{b}{bb}", f"k{kind}"]


class Editor:
    """weights: feature -> operation -> weight; operations of a character are those seen for it."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str | None, float]] = {}
        self.operations: dict[str, list[str | None]] = {}
        self.margin = 0.0  # score against keeping all from which an edit is made; see train

    def scores(self, word: str, i: int) -> dict[str | None, float]:
        out = dict.fromkeys(self.operations.get(word[i], [KEEP]), 0.0)
        for f in features(word, i):
            w = self.weights.get(f)
            if w:
                for op in out:
                    out[op] += w.get(op, 0.0)
        return out

    def train(self, pairs: list[tuple[str, str]], rounds: int = 15, least: int = 2, seed: int = 5) -> Editor:
        """pairs of (seen, true); operations seen fewer than `least` times are no operations."""
        rows = [(s, align(s, t)) for s, t in pairs]
        seen = Counter((c, op) for s, ops in rows for c, op in zip(s, ops))
        self.operations = defaultdict(list)
        for (c, op), n in sorted(seen.items(), key=lambda x: (-x[1], x[0][0], x[0][1] or "")):
            if op is KEEP or n >= least:
                self.operations[c].append(op)
        for c in self.operations:
            if KEEP not in self.operations[c]:
                self.operations[c].append(KEEP)
        self.operations = dict(self.operations)
        sums: dict[str, dict[str | None, float]] = {}
        self.weights, order, step = {}, list(range(len(rows))), 1
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                word, ops = rows[k]
                for i, op in enumerate(ops):
                    if op not in self.operations[word[i]]:
                        continue
                    sc = self.scores(word, i)
                    got = max(sc, key=lambda o: (sc[o], o is KEEP, o or ""))
                    if got != op:
                        for f in features(word, i):
                            for o, d in ((op, 1.0), (got, -1.0)):
                                w, s = self.weights.setdefault(f, {}), sums.setdefault(f, {})
                                w[o] = w.get(o, 0.0) + d
                                s[o] = s.get(o, 0.0) + d * step
                    step += 1
        for f, w in self.weights.items():  # the average over all steps
            for o in w:
                w[o] -= sums[f][o] / step
        # pairs are of words that no clean text holds, which keeping favours too much: all but MISSED of them are made
        edits = sorted(self.against_keeping(s, ops) for s, ops in rows if any(op is not KEEP for op in ops))
        self.margin = min(0.0, edits[int(MISSED * len(edits))]) if edits else 0.0
        return self

    def against_keeping(self, word: str, ops: list[str | None]) -> float:
        """Score of the operations less that of keeping every character; operations never seen rule an edit out."""
        out = 0.0
        for i, op in enumerate(ops):
            if op is not KEEP:
                sc = self.scores(word, i)
                out += sc.get(op, float("-inf")) - sc.get(KEEP, 0.0)
        return out

    def corrections(self, word: str, most: int = 2, beam: int = 60) -> list[tuple[float, str, list[int]]]:
        """(score against keeping all, text, edited positions), best first, with at most `most` edits.

        A replaced character whose neighbour is then deleted (two characters that stand for one) is one edit;
        nothing else is deleted.
        """
        states: list[tuple[float, str, list[int], int]] = [(0.0, "", [], 0)]
        for i, c in enumerate(word):
            sc = self.scores(word, i)
            keep = sc.get(KEEP, 0.0)
            nxt = []
            for score, text, at, n in states:
                nxt.append((score, text + c, at, n))
                for op, s in sc.items():
                    if op is KEEP:
                        continue
                    joint = bool(at) and at[-1] == i - 1 and op == ""
                    if op == "" and not joint:
                        continue
                    if n + (not joint) <= most:
                        nxt.append((score + s - keep, text + op, [*at, i], n + (not joint)))
            nxt.sort(key=lambda x: -x[0])
            have = [0] * (most + 1)  # the best of every number of edits stay
            states = []
            for x in nxt:
                have[x[3]] += 1
                if have[x[3]] <= beam:
                    states.append(x)
        return sorted(((s, t, at) for s, t, at, n in states if at), key=lambda x: (len(x[2]), -x[0]))


class Joiner:
    """An averaged perceptron that decides whether a line end lies inside a word."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, active: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in active)

    def train(self, rows: list[tuple[list[str], bool]], rounds: int = 8, seed: int = 5) -> Joiner:
        sums: dict[str, float] = {}
        order, step, rng = list(range(len(rows))), 1, random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                active, yes = rows[k]
                if (self.score(active) > 0) != yes:
                    d = 1.0 if yes else -1.0
                    for f in active:
                        self.weights[f] = self.weights.get(f, 0.0) + d
                        sums[f] = sums.get(f, 0.0) + d * step
                step += 1
        for f in self.weights:
            self.weights[f] -= sums.get(f, 0.0) / step
        return self
