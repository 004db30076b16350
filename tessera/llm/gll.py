"""Recognition by generalised LL over a graph-structured stack.

A grammar is written in EBNF. Every nonterminal becomes a small automaton whose steps are terminals and nonterminals.
Descriptors (state, stack node) are processed token by token: a nonterminal step calls, which makes or shares the stack
node of that nonterminal at this position; the end of a nonterminal returns along all edges of its node. Several start
symbols, one per dialect, run together and share tables and stacks; a text is rejected when no descriptor survives.

One token of lookahead prunes calls and returns. Where a single descriptor with a single step is left, which is most of
the time, the loop follows it without the bookkeeping of the general case.
"""

from __future__ import annotations

import re

_EBNF = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|'(?P<lit>(?:[^'\\]|\\.)+)'|(?P<op>[=|;()\[\]{}]))")
END = "<end>"


class Grammar:
    """EBNF: `Name = a 'b' [c] {d} (e | f) ;`. Names in capitals and quoted strings are terminals."""

    def __init__(self, text: str, starts: list[str]) -> None:
        self.rules: dict[str, tuple] = {}
        self.terminals: dict[str, int] = {END: 0}
        self._read(text)
        self._build()
        self.starts = starts
        self._sets()
        self._acts: list[dict[int, tuple]] = [{} for _ in self.owner]

    # --- reading ---

    def _read(self, text: str) -> None:
        text = text.strip()
        toks, at = [], 0
        while at < len(text):
            m = _EBNF.match(text, at)
            if not m:
                raise ValueError(f"grammar text at {text[at:at + 40]!r}")
            toks.append(("lit", m["lit"].replace("\\'", "'").replace("\\\\", "\\")) if m["lit"] else ("name", m["name"]) if m["name"] else ("op", m["op"]))
            at = m.end()
        self._toks, self._at = toks, 0
        while self._at < len(toks):
            name = toks[self._at][1]
            if toks[self._at + 1] != ("op", "="):
                raise ValueError(f"rule {name}")
            self._at += 2
            body = self._alternatives()
            if toks[self._at] != ("op", ";"):
                raise ValueError(f"rule {name} isn't ended")
            self._at += 1
            if name in self.rules:
                raise ValueError(f"rule {name} is given twice")
            self.rules[name] = body

    def _alternatives(self) -> tuple:
        out = [self._sequence()]
        while self._toks[self._at] == ("op", "|"):
            self._at += 1
            out.append(self._sequence())
        return ("alt", out) if len(out) > 1 else out[0]

    def _sequence(self) -> tuple:
        out = []
        while True:
            kind, value = self._toks[self._at]
            if kind == "op" and value in "|;)]}":
                return ("seq", out)
            self._at += 1
            if kind == "op":
                body = self._alternatives()
                self._at += 1
                out.append({"(": body, "[": ("opt", body), "{": ("rep", body)}[value])
            elif kind == "lit" or value.isupper():
                out.append(("t", self.terminals.setdefault(value, len(self.terminals))))
            else:
                out.append(("n", value))

    # --- automata ---

    def _build(self) -> None:
        self.term: list[dict[int, int]] = []
        self.calls: list[list[tuple[int, int]]] = []
        self.final: list[bool] = []
        self.owner: list[int] = []
        self.names = list(self.rules)
        self.number = {n: i for i, n in enumerate(self.names)}
        self.start: list[int] = []
        for index, name in enumerate(self.names):
            self._automaton(index, self.rules[name])
        if "ANY" in self.terminals:  # stands for every terminal but brackets and the end
            no = {self.terminals[x] for x in (END, "ANY", "(", ")", "[", "]", "{", "}") if x in self.terminals}
            for steps in self.term:
                if self.terminals["ANY"] in steps:
                    to = steps.pop(self.terminals["ANY"])
                    for t in self.terminals.values():
                        if t not in no:
                            steps.setdefault(t, to)

    def _automaton(self, index: int, body: tuple) -> None:
        free: list[list[int]] = [[]]
        moves: list[list[tuple[tuple, int]]] = [[]]

        def node() -> int:
            free.append([])
            moves.append([])
            return len(free) - 1

        def lay(b: tuple, a: int) -> int:
            kind = b[0]
            if kind == "seq":
                for x in b[1]:
                    a = lay(x, a)
                return a
            end = node()
            if kind == "alt":
                for x in b[1]:
                    free[lay(x, a)].append(end)
            elif kind == "opt":
                free[a].append(end)
                free[lay(b[1], a)].append(end)
            elif kind == "rep":
                hub = node()
                free[a].append(hub)
                free[lay(b[1], hub)].append(hub)
                free[hub].append(end)
            else:
                if kind == "n" and b[1] not in self.number:
                    raise ValueError(f"no rule {b[1]}")
                moves[a].append(((kind, b[1] if kind == "t" else self.number[b[1]]), end))
            return end

        last = lay(body, 0)

        def closure(nodes: set[int]) -> frozenset[int]:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for x in free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        known: dict[frozenset[int], int] = {}

        def state(nodes: frozenset[int]) -> int:
            if nodes in known:
                return known[nodes]
            s = known[nodes] = len(self.owner)
            self.term.append({})
            self.calls.append([])
            self.final.append(last in nodes)
            self.owner.append(index)
            by: dict[tuple, set[int]] = {}
            for x in nodes:
                for symbol, to in moves[x]:
                    by.setdefault(symbol, set()).add(to)
            for (kind, value), to in sorted(by.items()):
                target = state(closure(to))
                if kind == "t":
                    self.term[s][value] = target
                else:
                    self.calls[s].append((value, target))
            return s

        self.start.append(state(closure({0})))

    def _sets(self) -> None:
        n = len(self.owner)
        first: list[set[int]] = [set(t) for t in self.term]
        empty = list(self.final)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for callee, after in self.calls[s]:
                    new = first[self.start[callee]]
                    if empty[self.start[callee]]:
                        new = new | first[after]
                        if empty[after] and not empty[s]:
                            empty[s] = changed = True
                    if not new <= first[s]:
                        first[s] |= new
                        changed = True
        follow: list[set[int]] = [set() for _ in self.names]
        for name in self.starts:
            follow[self.number[name]].add(0)
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for callee, after in self.calls[s]:
                    new = first[after] | (follow[self.owner[s]] if empty[after] else set())
                    if not new <= follow[callee]:
                        follow[callee] |= new
                        changed = True
        self.first, self.empty, self.follow = first, empty, follow

    def _act(self, s: int, t: int) -> tuple:
        """(kind, x, y, steps): kind 1 shift to x, 2 call x returning to y, 3 return, 0 none, 4 several steps."""
        steps: list[tuple[int, int, int]] = []
        if t in self.term[s]:
            steps.append((1, self.term[s][t], 0))
        for callee, after in self.calls[s]:
            start = self.start[callee]
            beyond = t in self.first[after] or (self.empty[after] and t in self.follow[self.owner[s]])
            if t in self.first[start] or (self.empty[start] and beyond):
                steps.append((2, start, after))
        if self.final[s] and t in self.follow[self.owner[s]]:
            steps.append((3, 0, 0))
        out = (*steps[0], ()) if len(steps) == 1 else (4 if steps else 0, 0, 0, tuple(steps))
        self._acts[s][t] = out
        return out

    # --- recognition ---

    def begin(self) -> list[tuple[int, list | None]]:
        return [(self.start[self.number[name]], None) for name in self.starts]

    def step(self, active: list[tuple[int, list | None]], t: int) -> list[tuple[int, list | None]]:
        """Descriptors after token t; for the end (0) those that accept."""
        acts = self._acts
        if len(active) == 1:
            s, node = active[0]
            while True:
                a = acts[s].get(t) or self._act(s, t)
                kind = a[0]
                if kind == 1:
                    return [(a[1], node)]
                if kind == 2:
                    node = [(a[2], node)]
                    s = a[1]
                elif kind == 3 and node is not None and len(node) == 1:
                    s, node = node[0]
                elif kind == 3 and node is None:
                    return [(-1, None)] if t == 0 else []
                elif kind == 0:
                    return []
                else:
                    active = [(s, node)]
                    break
        work = list(active)
        seen: set[tuple[int, int]] = set()
        made: dict[int, list] = {}
        returned: set[int] = set()
        out: list[tuple[int, list | None]] = []
        shifted: set[tuple[int, int]] = set()
        while work:
            s, node = work.pop()
            key = (s, id(node))
            if key in seen:
                continue
            seen.add(key)
            a = acts[s].get(t) or self._act(s, t)
            for kind, x, y in a[3] if a[0] in (0, 4) else (a[:3],):
                if kind == 1:
                    if (x, id(node)) not in shifted:
                        shifted.add((x, id(node)))
                        out.append((x, node))
                elif kind == 2:
                    child = made.get(x)
                    if child is None:
                        child = made[x] = [(y, node)]
                        work.append((x, child))
                    elif not any(after == y and parent is node for after, parent in child):
                        child.append((y, node))
                        if id(child) in returned:
                            work.append((y, node))
                elif node is None:
                    if t == 0:
                        return [(-1, None)]
                else:
                    returned.add(id(node))
                    work.extend(node)
        return out

    def recognise(self, tokens: list[int]) -> int:
        """-1 if some dialect accepts the tokens, else the number of the token that no dialect can take."""
        active = self.begin()
        for at, t in enumerate(tokens):
            active = self.step(active, t)
            if not active:
                return at
        return -1 if self.step(active, 0) else len(tokens)

    def recognise_with_insertion(self, tokens: list[int], after_line: list[bool], inserted: int, brace: int) -> int:
        """As recognise, with a token that may be put before one that can't be taken.

        That is where a line ended before it or where it closes a block; before the latter, descriptors that can go on
        and those that need the insertion live side by side.
        """
        active = self.begin()
        for at, t in enumerate(tokens):
            then = self.step(active, t)
            if t == brace or (not then and after_line[at]):
                more = self.step(active, inserted)
                if more:
                    then = then + [d for d in self.step(more, t) if not any(d[0] == e[0] and d[1] is e[1] for e in then)]
            if not then:
                return at
            active = then
        if self.step(active, 0):
            return -1
        then = self.step(active, inserted)
        return -1 if then and self.step(then, 0) else len(tokens)
