"""Probabilistic automata learned from example strings by merging states of their prefix tree.

Each state of the prefix tree counts the strings that reach it, end in it, and leave it by
each character. In breadth-first order every state is compared with the states already
settled: where the Hoeffding bound allows the same end and character rates in both, and
in the states that follow them, the two are merged and their continuations folded into
each other; otherwise the state is settled as a new one. Rates are compared by character
and by class of characters, as few strings show a class long before they show a letter.

`learn` does so for strings at hand; `Growing` for a table, from counts of the next characters.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

#: Classes of characters with their sizes, END among them; strings that a rate's backing weighs.
SIZES = {"A": 26, "a": 26, "9": 10, "-": 6, "": 1}
BACKING = 1.0
END = ""


def class_of(char: str) -> str:
    return "9" if char.isdigit() else "A" if char.isupper() else "a" if char.islower() else "-" if char else END


def _by_class(sent: dict[str, int]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for char, n in sent.items():
        counts[class_of(char)] = counts.get(class_of(char), 0) + n
    return counts


@dataclass
class Automaton:
    """Per state: `arrived` strings, `ended` strings, and by character the next state and how many went there."""

    arrived: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    go: list[dict[str, int]] = field(default_factory=lambda: [{}])
    sent: list[dict[str, int]] = field(default_factory=lambda: [{}])

    @property
    def states(self) -> int:
        return len(self.arrived)

    @cached_property
    def backing(self) -> tuple[dict[str, int], dict[str, int], list[dict[str, int]], list[dict[str, int]]]:
        """Counts of characters and of classes over all states; per state its classes, and where most of a class go."""
        chars = Counter({END: sum(self.ended)})
        classes, way = [], []
        for sent, go in zip(self.sent, self.go):
            chars.update(sent)
            classes.append(_by_class(sent))
            way.append({class_of(c): go[c] for c in sorted(sent, key=lambda c: (sent[c], c))})
        return dict(chars), _by_class(chars), classes, way

    def log_likelihood(self, text: str) -> float:
        """Log-probability of the whole string.

        A state's rate of a character is backed by its rate of the character's class, that by the
        rate of the class in all states. A character that a state does not know leads where most
        of its class go, or where it would lead from the first state.
        """
        chars, whole, classes, way = self.backing
        every = sum(whole.values())
        state, total = 0, 0.0
        for at in range(len(text) + 1):
            char = text[at] if at < len(text) else END
            kind = class_of(char)
            arrived = self.arrived[state]
            seen, alike = (self.sent[state].get(char, 0), classes[state].get(kind, 0)) if char else (self.ended[state],) * 2
            share = (chars.get(char, 0) + 1) / (whole.get(kind, 0) + SIZES[kind])
            common = (whole.get(kind, 0) + 1) / (every + len(SIZES))
            backed = (alike + BACKING * common) / (arrived + BACKING) * share
            total += math.log((seen + BACKING * backed) / (arrived + BACKING))
            after = self.go[state].get(char)
            if after is None:
                after = way[state].get(kind)
            state = self.go[0].get(char, way[0].get(kind, 0)) if after is None else after
        return total


def prefix_tree(strings: Iterable[str]) -> Automaton:
    tree = Automaton()
    for text in strings:
        state = 0
        tree.arrived[0] += 1
        for char in text:
            after = tree.go[state].get(char)
            if after is None:
                after = tree.go[state][char] = tree.states
                tree.arrived.append(0)
                tree.ended.append(0)
                tree.go.append({})
                tree.sent.append({})
            tree.sent[state][char] = tree.sent[state].get(char, 0) + 1
            tree.arrived[after] += 1
            state = after
        tree.ended[state] += 1
    return tree


def _alike(machine: Automaton, a: int, b: int, width: float) -> bool:
    """Whether the rates of two states, and of all states that both lead to, can be the same."""
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        n, m = machine.arrived[a], machine.arrived[b]
        bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if bound >= 1:  # too few strings to tell; so are those of the states that follow
            continue
        if abs(machine.ended[a] / n - machine.ended[b] / m) > bound:
            return False
        x, y = machine.sent[a], machine.sent[b]
        for left, right in ((x, y), (_by_class(x), _by_class(y))):
            if any(abs(left.get(c, 0) / n - right.get(c, 0) / m) > bound for c in left.keys() | right.keys()):
                return False
        waiting.extend((machine.go[a][char], machine.go[b][char]) for char in sorted(x.keys() & y.keys()))
    return True


def _fold(machine: Automaton, into: int, tree: int) -> None:
    """Add the counts of a subtree to a state and the states that follow it."""
    waiting = [(into, tree)]
    while waiting:
        a, b = waiting.pop()
        machine.arrived[a] += machine.arrived[b]
        machine.ended[a] += machine.ended[b]
        for char, after in machine.go[b].items():
            if char in machine.go[a]:
                machine.sent[a][char] += machine.sent[b][char]
                waiting.append((machine.go[a][char], after))
            else:
                machine.go[a][char], machine.sent[a][char] = after, machine.sent[b][char]


def learn(strings: Iterable[str], alpha: float = 1e-6) -> Automaton:
    """The merged automaton; `alpha` is the risk of telling two equal states apart. No strings: one state."""
    machine = prefix_tree(strings)
    if not machine.arrived[0]:
        return machine
    width = math.sqrt(0.5 * math.log(2 / alpha))
    settled, known = [0], {0}
    edges = deque((0, char) for char in sorted(machine.go[0]))
    while edges:
        source, char = edges.popleft()
        state = machine.go[source][char]
        if state in known:
            continue
        match = next((s for s in settled if _alike(machine, s, state, width)), None)
        if match is None:
            settled.append(state)
            known.add(state)
            edges.extend((state, c) for c in sorted(machine.go[state]))
            continue
        machine.go[source][char] = match
        _fold(machine, match, state)
        # folding hangs new subtrees under settled states: their edges are looked at (again)
        edges.extend((s, c) for s in settled for c in sorted(machine.go[s]) if machine.go[s][c] not in known)
    number = {s: i for i, s in enumerate(settled)}
    return Automaton(
        [machine.arrived[s] for s in settled],
        [machine.ended[s] for s in settled],
        [{c: number[t] for c, t in machine.go[s].items()} for s in settled],
        [dict(machine.sent[s]) for s in settled],
    )


#: Characters ahead by which two states are compared, and what stands for the end of a string there.
AHEAD, STOP = 2, "\n"


def ahead(text: str, at: int) -> str:
    """The next characters of a string from `at`, its end among them."""
    gram = text[at : at + AHEAD]
    return gram if len(gram) == AHEAD else gram + STOP


def _close(x: dict[str, int], y: dict[str, int], width: float) -> bool:
    """Whether the rates of characters (END among them) and of their classes can be the same."""
    n, m = sum(x.values()), sum(y.values())
    bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    if bound >= 1:  # too few strings to tell
        return True
    for left, right in ((x, y), (_by_class(x), _by_class(y))):
        if any(abs(left.get(c, 0) / n - right.get(c, 0) / m) > bound for c in left.keys() | right.keys()):
            return False
    return True


def _followers(grams: dict[str, int]) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """Counts of the next character, and after each character of the one that follows."""
    first: dict[str, int] = {}
    second: dict[str, dict[str, int]] = {}
    for gram, n in grams.items():
        char = END if gram[0] == STOP else gram[0]
        first[char] = first.get(char, 0) + n
        if char:
            after = END if gram[1] == STOP else gram[1]
            own = second.setdefault(char, {})
            own[after] = own.get(after, 0) + n
    return first, second


def _alike_ahead(a: dict[str, int], b: dict[str, int], width: float) -> bool:
    (x, far_x), (y, far_y) = _followers(a), _followers(b)
    return _close(x, y, width) and all(_close(far_x[c], far_y[c], width) for c in sorted(far_x.keys() & far_y.keys()))


@dataclass
class Growing:
    """An automaton learned from counts over any number of strings, a round of counting for each depth.

    A string is followed as far as the transitions are known. Counted are the next characters at
    each state on its way, and those behind the first unknown transition. `settle` compares what
    lies behind each unknown transition with the settled states, in the order of these, and either
    lets it lead to one of them or makes it a state of its own.
    """

    go: list[dict[str, int]] = field(default_factory=lambda: [{}])
    grams: list[Counter] = field(default_factory=lambda: [Counter()])

    def follow(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(state, the unknown character that leaves it or none, next characters) along a string."""
        state = 0
        for at in range(len(text) + 1):
            yield state, END, ahead(text, at)
            if at < len(text):
                after = self.go[state].get(text[at])
                if after is None:
                    yield state, text[at], ahead(text, at + 1)
                    return
                state = after

    def settle(self, counts: Iterable[tuple[int, str, str, int]], alpha: float) -> bool:
        """Take in the counts of a round (state, character, next characters, strings); False at the end."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        self.grams = [Counter() for _ in self.go]
        unknown: dict[tuple[int, str], Counter] = {}
        for state, char, gram, n in counts:
            (unknown.setdefault((state, char), Counter()) if char else self.grams[state])[gram] += n
        for (state, char), grams in sorted(unknown.items(), key=lambda x: x[0]):
            match = next((s for s, own in enumerate(self.grams) if _alike_ahead(own, grams, width)), None)
            if match is None:
                match = len(self.go)
                self.go.append({})
                self.grams.append(grams)
            else:
                self.grams[match] = self.grams[match] + grams
            self.go[state][char] = match
        return bool(unknown)

    def automaton(self) -> Automaton:
        """The automaton after the last round, with the counts of all strings."""
        followers = [_followers(g)[0] for g in self.grams]
        return Automaton(
            [sum(f.values()) for f in followers],
            [f.get(END, 0) for f in followers],
            [dict(g) for g in self.go],
            [{c: n for c, n in f.items() if c} for f in followers],
        )
