"""Secret scans by one combined deterministic automaton.

Every rule is a regular expression over bytes: a head, then a body of at least
``least`` characters.  All rules are parsed into one position automaton, turned
into a deterministic one by subset construction, minimised by partition
refinement and stored as transition arrays (byte -> byte class, state x class ->
state, state -> rules that end there).  One pass over the bytes finds, for all rules at once,
which stretches of text hold a match of which rules; a stretch ends where the byte before
resets every state (a line break, a comma), so no match crosses two of them.  Many stretches
are walked in step; the few longest are finished one by one.

In a stretch with a hit, the rule's own automata (head, and head with body, without the minimum)
give the spans: leftmost, longest, not overlapping within a kind; a match whose
body is shorter than the minimum is consumed and dropped.  A walk remembers the (state, byte) pairs
from which no match was reached, and a later walk that meets one of them ends: the time is linear in the
text.  Only states on a cycle of the automaton are remembered (any long walk meets one), in one byte
for each byte of the stretch and such state that a failed walk has been in.

Any number of rules: the rule bits are kept in as many bytes as the rules need.

* null and empty texts: no spans, counts 0, the digest of the empty string
* offsets are code points, the end is exclusive; documents are whole, of any length
* repeated rows and repeated ids: one result per row
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import as_bytes, slices


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    body: str  # a character class
    least: int  # characters of the body


#: The three base kinds, then the kinds that this operator adds.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
         r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
ADDED = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 20),
    Rule("slack", "xox[abprs]-", r"[A-Za-z0-9\-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.", r"[A-Za-z0-9_\-]", 10),
    Rule("pem", "-----BEGIN( [A-Z]+)* PRIVATE KEY", r"[\-]", 5),
)
RULES = BASE + ADDED


class _Nfa:
    """Thompson automaton of a small regular expression language: literals,
    escapes, classes, groups, ``|``, ``?``, ``*`` and ``+``."""

    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def _atom(self, chars: frozenset) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.step[a] = (chars, b)
        return a, b

    def add(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        frag = self._either()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} in {text!r}")
        return frag

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        frags = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            frags.append(self._sequence())
        if len(frags) == 1:
            return frags[0]
        a, b = self.state(), self.state()
        for x, y in frags:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def _sequence(self):
        a = end = self.state()
        while self._peek() not in ("", "|", ")"):
            x, y = self._repeated()
            self.free[end].append(x)
            end = y
        return a, end

    def _repeated(self):
        x, y = self._single()
        while (q := self._peek()) and q in "?*+":
            self.at += 1
            a, b = self.state(), self.state()
            self.free[a].append(x)
            self.free[y].append(b)
            if q != "+":
                self.free[a].append(b)
            if q != "?":
                self.free[y].append(x)
            x, y = a, b
        return x, y

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _single(self):
        if self._peek() == "(":
            self.at += 1
            frag = self._either()
            self.at += 1
            return frag
        if self._peek() != "[":
            return self._atom(frozenset([self._char()]))
        self.at += 1
        chars: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            chars.update(range(low, high + 1))
        self.at += 1
        return self._atom(frozenset(chars))

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Minimal deterministic automaton of several expressions; ``accept`` holds
    the bits of the expressions that end in a state.  ``floating``: a match may
    start at any byte."""

    def __init__(self, expressions: list[str], floating: bool):
        nfa, ends, starts = _Nfa(), {}, []
        for k, e in enumerate(expressions):
            a, b = nfa.add(e)
            starts.append(a)
            ends[b] = 1 << k
        self.classes, samples = self._byte_classes([s[0] for s in nfa.step if s])
        start = nfa.closure(starts)
        number, order, rows = {start: 0}, [start], []
        for states in order:  # grows while it is walked
            moves = [nfa.step[s] for s in states if nfa.step[s]]
            row = []
            for byte in samples:
                to = {t for chars, t in moves if byte in chars}
                target = nfa.closure(to) | start if floating else nfa.closure(to)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        accept = [0] * len(order)
        for k, states in enumerate(order):
            for s in states:
                accept[k] |= ends.get(s, 0)
        self.table, self.accept = self._minimal(np.array(rows), accept)
        #: a state that no byte leaves and that accepts nothing (-1: none)
        dead = [k for k, row in enumerate(self.table) if (row == k).all() and not self.accept[k]]
        self.dead = dead[0] if dead and not floating else -1

    @staticmethod
    def _byte_classes(sets: list[frozenset]) -> tuple[np.ndarray, list[int]]:
        member = np.zeros((256, len(sets)), bool)
        for k, chars in enumerate(sets):
            member[sorted(chars), k] = True
        _, first, inverse = np.unique(member, axis=0, return_index=True, return_inverse=True)
        return inverse.ravel().astype(np.int64), [int(x) for x in first]

    @staticmethod
    def _minimal(table: np.ndarray, accept: list[int]) -> tuple[np.ndarray, list[int]]:
        """Partition refinement: states stay together while they agree on their
        rules and on the parts that all byte classes lead to."""
        number: dict[int, int] = {}
        part = np.array([number.setdefault(bits, len(number)) for bits in accept])  # the bits may be wider than 64
        while True:
            _, first, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_index=True, return_inverse=True)
            new = new.ravel()
            if new.max() == part.max():
                break
            part = new
        # the start state becomes 0
        swap = np.arange(len(first))
        swap[[0, new[0]]] = swap[[new[0], 0]]
        table, accept = swap[new[table[first]]], [accept[k] for k in first]
        return table[swap], [accept[k] for k in swap]

    def cyclic(self) -> list[bool]:
        """States that a walk can come back to."""
        reach = np.zeros((len(self.table),) * 2, bool)
        for k, row in enumerate(self.table):
            reach[k, row[row != self.dead]] = True
        for k in range(len(reach)):
            reach |= np.outer(reach[:, k], reach[k])
        return reach.diagonal().tolist()


FEW = 8  # stretches that are not worth a step in common
BLOCK = 1 << 20


class Scanner:
    """The combined automaton of all rules and the rules' own ones."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, stretch: int = 2048):
        self.rules, self.stretch = rules, stretch
        # after a head one character of the body is enough here (the spans apply the minimum);
        # counting all minima side by side would multiply the states
        self.all = Dfa([r.head + r.body * (1 if r.head else r.least) for r in rules], floating=True)
        self.width = self.all.table.shape[1]
        self.flat = (self.all.table * self.width).astype(np.int32).ravel()
        # the rules that end in a state, eight to a byte; looked up per row start
        words = -(-len(rules) // 8)
        self.masks = [np.zeros(len(self.flat), np.uint8) for _ in range(words)]
        for w, mask in enumerate(self.masks):
            mask[:: self.width] = [bits >> (8 * w) & 255 for bits in self.all.accept]
        resets = (self.all.table == self.all.table[0]).all(axis=0)
        same = self.all.table[0][self.all.classes] == 0
        self.reset = resets[self.all.classes] & same
        self.kinds = self.all.classes.astype(np.uint8)
        self.heads = [Dfa([r.head], floating=False) for r in rules]
        self.wholes = [Dfa([r.head + r.body + "+"], floating=False) for r in rules]
        self.tables = [(d.table.tolist(), d.accept, d.dead, d.cyclic(), bytes(d.classes.tolist())) for d in self.wholes]

    def hits(self, data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Bits of the rules that match inside every stretch of ``data``, eight rules to an array."""
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        sizes, pos = sizes[order], starts[order]
        kind = self.kinds[data]
        state = np.zeros(len(pos), np.int32)
        seen = [np.zeros(len(pos), np.uint8) for _ in self.masks]
        step = int(sizes[FEW]) if len(sizes) > FEW else 0  # as long as more than FEW stretches go on, in step
        for n in np.searchsorted(-sizes, -np.arange(step), "left"):  # stretches longer than the step
            s = self.flat[state[:n] + kind[pos[:n]]]
            state[:n] = s
            for bits, mask in zip(seen, self.masks):
                bits[:n] |= mask[s]
            pos[:n] += 1
        flat = self.flat.tolist() if step < sizes[0] else []
        for k in range(min(FEW, len(sizes))):
            s, entered = int(state[k]), set()
            for at in range(int(pos[k]), int(pos[k] + sizes[k] - step), BLOCK):
                for c in kind[at : min(at + BLOCK, int(pos[k] + sizes[k] - step))].tolist():
                    s = flat[s + c]
                    entered.add(s)
            for bits, mask in zip(seen, self.masks):
                bits[k] |= np.bitwise_or.reduce(mask[list(entered)]) if entered else 0
        out = [np.zeros(len(starts), np.uint8) for _ in self.masks]
        for bits, found in zip(out, seen):
            bits[order] = found
        return out

    def spans(self, text: bytes, k: int) -> list[tuple[int, int]]:
        """Byte spans of rule ``k``, in linear time."""
        whole, head, out, at = self.wholes[k], self.heads[k], [], 0
        table, accept, dead, cyclic, classes = self.tables[k]
        can_start = np.flatnonzero((whole.table[0] != dead)[whole.classes][np.frombuffer(text, np.uint8)])
        kinds = text.translate(classes)
        n, failed = len(kinds), {}
        for start in can_start:
            if start < at:
                continue
            start = int(start)
            state, end, i = 0, -1, start
            met: list[tuple[int, int]] = []  # since the last end of a match
            while i < n:
                state = table[state][kinds[i]]
                if state == dead:
                    break
                i += 1
                if accept[state]:
                    end = i
                    if met:
                        met = []
                elif cyclic[state]:
                    if state in failed and failed[state][i - 1]:
                        break
                    met.append((state, i - 1))
            for state, i in met:
                if state not in failed:
                    failed[state] = bytearray(n)
                failed[state][i] = 1
            if end > start:
                at = end
                if end - self._head_end(head, text, start, end) >= self.rules[k].least:
                    out.append((start, end))
        return out

    @staticmethod
    def _head_end(head: Dfa, text: bytes, start: int, stop: int) -> int:
        """End of the longest head at ``start`` that leaves a body before ``stop``."""
        state, end = 0, start
        for i in range(start, stop - 1):
            state = head.table[state][head.classes[text[i]]]
            if state == head.dead:
                break
            if head.accept[state]:
                end = i + 1
        return end

    def stretches(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of stretches of about ``stretch`` bytes that no match crosses; a text starts one."""
        cuts = np.flatnonzero(self.reset[data]) + 1
        at = np.searchsorted(cuts, np.arange(self.stretch, len(data), self.stretch))
        starts = np.unique(np.concatenate([[0], ends, cuts[at[at < len(cuts)]]]))
        return starts[starts < len(data)]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the (start, rule number, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = b"".join(texts)
        if not joined:
            return out
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = self.stretches(data, ends)
        stops = np.append(starts[1:], len(data))
        owner = np.searchsorted(ends, starts, "right")
        known = (-1, 0, 0)  # text, byte and code points before it
        hits = self.hits(data, starts)
        for x in np.flatnonzero(np.bitwise_or.reduce(hits)).tolist():
            a, b, text = int(starts[x]), int(stops[x]), int(owner[x])
            at, before = known[1:] if known[0] == text else (int(ends[text]) - len(texts[text]), 0)
            before += int(np.count_nonzero((data[at:a] & 0xC0) != 0x80))
            known = (text, a, before)
            points = np.cumsum((data[a:b] & 0xC0) != 0x80) + before
            part = joined[a:b]
            for k in range(len(self.rules)):
                if hits[k // 8][x] >> (k % 8) & 1:
                    out[text] += [(int(points[i]) - 1, k, int(points[j - 1])) for i, j in self.spans(part, k)]
        return [sorted(found) for found in out]


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    scanner = Scanner(rules)  # a few tables of some 100 KB

    def run(batches):
        shown = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
        for batch in slices(batches, 512):
            found = scanner.scan(as_bytes(batch))
            base = [[x for x in s if x[1] < len(BASE)] for s in found]
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(BASE))]
            digests = [hashlib.sha256(shown(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                 pa.array([shown(s) for s in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")
