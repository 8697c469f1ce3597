"""Byte-pair merges as a lazily determinised finite-state transducer, and as a prefix dynamic program.

A sequence of tokens is the encoding of its text exactly if each token encodes its own text and each two
neighbours encode theirs (merges inside a token never look outside it, and the first merge across a
boundary would show in the pair already). So every prefix of a text has one last token: the one that ends
there and fits the last token of the prefix before it. Both classes below rest on that.

Texts are strings of symbols, one character a symbol: for bytes their Latin-1 characters, for the last
byte of a word in vocabularies with word ends the byte plus END.
"""

from __future__ import annotations

from collections.abc import Callable

#: Added to the last byte of a word by vocabularies with word ends.
END = 256
#: Pieces up to so many characters are remembered.
MEMO_CHARS = 48
#: Bits of a symbol and of a token's id in a transducer's tables.
SYMBOL_BITS, TOKEN_BITS = 9, 24
#: Bits of a token's length.
LENGTH_BITS = 12


class Memo(dict):
    """Pieces met lately and what was made of them; what is missing is made.

    Two generations of most_bytes / 2 each, by weigh(piece, made): when the younger is full, the older goes, and
    what is asked for again comes over. So frequent pieces stay and the size is bounded.
    """

    def __init__(self, make: Callable, most_bytes: int, weigh: Callable):
        super().__init__()
        self.make, self.most, self.weigh = make, most_bytes // 2, weigh
        self.older: dict = {}
        self.bytes = 0

    def __missing__(self, piece: str):
        made = self.older.pop(piece, None)
        if made is None:
            made = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if self.bytes > self.most:
                self.older, self.bytes = dict(self), 0
                self.clear()
            self.bytes += self.weigh(piece, made)
            self[piece] = made
        return made


class Merges:
    """A vocabulary with the order of its merges.

    ids: token text to id. order(a, b): the rank at which two neighbouring tokens merge, or None. Verdicts on so
    many pairs and the edges of so many tokens are remembered. own and starts hold the tokens that encode their own
    text, and what these begin with, each under itself, so that one string stands for all equal ones. ranks: the lowest
    rank of a merge that makes a token; its id if not given.
    """

    def __init__(self, ids: dict[str, int], order: Callable[[str, str], int | None], ranks: dict[str, int] | None = None, most_pairs: int = 150_000, most_edges: int = 20_000):
        self.ids, self.order, self.most_pairs, self.most_edges = ids, order, most_pairs, most_edges
        self.ranks = ids if ranks is None else ranks
        self._pairs: dict[tuple[str, str], bool] = {}
        self.own = {t: t for t in ids if len(t) == 1 or self.merge(t) == [t]}
        self.starts: dict[str, str] = {}
        for token in self.own:
            for n in range(1, len(token)):
                start = token[:n]
                self.starts.setdefault(start, start)
        self.longest = max(map(len, self.own), default=1)
        self._edges: dict[tuple[str, int], tuple[list[str], list[float], bool]] = {}
        self._lowest: dict[str, int] | None = None

    def merge(self, text: str) -> list[str]:
        """The merges carried out as defined, lowest rank first, then leftmost. Only used on short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.order(parts[i], parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: str, side: int) -> tuple[list[str], list[float], bool]:
        """The parts that stand in turn at a token's left (0) or right (-1) end while it is merged, the rank of the merge that ends each (infinite for the token), and whether the token's ranks only rise."""
        known = self._edges.get((token, side))
        if known is None:
            parts, found, ends, before, rising = list(token), [], [], -1, True
            while len(parts) > 1:
                rank, at = min((r, i) for i in range(len(parts) - 1) if (r := self.order(parts[i], parts[i + 1])) is not None)
                rising, before = rising and rank >= before, rank
                if at == (len(parts) - 2 if side else 0):
                    found.append(parts[side])
                    ends.append(rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self._edges) > self.most_edges:
                self._edges.clear()
            known = self._edges[token, side] = [*found, token], [*ends, float("inf")], rising
        return known

    def fit(self, a: str | None, b: str) -> bool:
        """Whether tokens a and b stay apart when their texts meet; a is None at the start of a text."""
        if a is None:
            return True
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > self.most_pairs:
                self._pairs.clear()
            known = self._pairs[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: str, b: str) -> bool:
        """Goes through the parts that stand at the boundary at the same time, in the order of merges; a pair merges there if its rank comes before the end of both.

        Of equal ranks the leftmost merges first. Where a token's ranks don't only rise, the merges are carried out.
        """
        left, left_ends, left_rising = self.edge(a, -1)
        right, right_ends, right_rising = self.edge(b, 0)
        if not (left_rising and right_rising):
            return self.merge(a + b) == [a, b]
        i = j = 0
        while True:
            rank, x, y = self.order(left[i], right[j]), left_ends[i], right_ends[j]
            if rank is not None and rank < x and rank <= y:
                return False
            if x <= y:
                if x == y == float("inf"):
                    return True
                i += 1
            else:
                j += 1


    def lowest(self, start: str) -> int | None:
        """The lowest rank of the tokens that begin with `start`."""
        if self._lowest is None:
            low: dict[str, int] = {}
            for token, rank in sorted(self.ranks.items(), key=lambda x: -x[1]):
                for n in range(1, len(token) + 1):
                    start = token[:n]
                    low[self.starts.get(start, start)] = rank
            self._lowest = low
        return self._lowest.get(start)

    def open_edge(self, token: str, text: str) -> tuple[tuple[str, float], ...]:
        """What of a token's right edge may still merge with a part of some token that begins with text.

        A part that goes before the lowest rank at which it could merge there can't; two tokens with the same
        open edge meet all those tokens alike.
        """
        parts, ends, _ = self.edge(token, -1)
        found, highest = [], -1
        for part, end in zip(parts, ends, strict=True):
            highest = max(highest, end)
            beyond = self.lowest(part + text)
            if beyond is not None and beyond <= highest or any((r := self.order(part, text[:n])) is not None and r <= highest for n in range(1, len(text) + 1)):
                found.append((part, end))
        return tuple(found)


class Transducer:
    """Reads a text symbol by symbol and emits tokens once no continuation can change them.

    A state is the list of places where a token may still begin: the text from there on, which starts a
    token, and the last token before, or one that meets all tokens of that start alike; where nothing can merge
    any more, none. So states are few more than starts of tokens. A transition gives the token that ends with its symbol, so the tokens
    of any prefix read so far follow backwards from its end. After every `window` symbols those that all
    open places share are emitted and forgotten, so what is held is bounded by the longest token. States and
    transitions are made when first reached; the tables are dropped beyond max_states, at the cost of time
    only. Places, states and transitions are whole numbers: some 400 bytes a state.
    """

    def __init__(self, merges: Merges, max_states: int):
        self.merges, self.max_states, self.window = merges, max_states, 4 * merges.longest
        self.length = {i: len(t) for t, i in merges.ids.items()}
        self._clear()

    def _clear(self) -> None:
        self.places: list[tuple[str, str | None]] = [("", None)]
        self.place_no = {self.places[0]: 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.known = {self.states[0]: 0}
        self.edges: dict[tuple, int] = {}
        self.alike: dict[tuple[str, int], str] = {}
        self.steps: dict[int, int] = {}  # state and symbol to the state after and the token that ends there
        self.lasts: dict[int, int] = {}  # the same without a state after, at the end of texts

    def _last(self, state: int, symbol: int) -> int:
        """The token that ends with the last symbol of a text; no state is made after it."""
        own, fit = self.merges.own, self.merges.fit
        for place in self.states[state]:
            text, last = self.places[place]
            token = own.get(text + chr(symbol))
            if token is not None and fit(last, token):
                found = self.lasts[state << SYMBOL_BITS | symbol] = self.merges.ids[token]
                return found
        raise ValueError(f"no token ends with {symbol!r}")

    def _place(self, text: str, last: str | None) -> int:
        place = (text, last)
        no = self.place_no.get(place)
        if no is None:
            no = self.place_no[place] = len(self.places)
            self.places.append(place)
        return no

    def _step(self, state: int, symbol: int) -> int:
        """The state after a symbol and the token that ends there, in one number."""
        own, starts, fit = self.merges.own, self.merges.starts, self.merges.fit
        live, new = [], None
        for place in self.states[state]:
            text, last = self.places[place]
            text += chr(symbol)
            start = starts.get(text)
            if start is not None:
                live.append(self._place(start, self._alike(last, start) if last else None))
            if new is None and (token := own.get(text)) is not None and fit(last, token):
                new = token
        if new is None:
            raise ValueError(f"no token ends with {symbol!r}")
        live.append(self._place("", new))
        key = tuple(live)
        after = self.known.setdefault(key, len(self.states))
        if after == len(self.states):
            self.states.append(key)
        step = self.steps[state << SYMBOL_BITS | symbol] = after << TOKEN_BITS | self.merges.ids[new]
        return step

    def _alike(self, last: str, text: str) -> str | None:
        """One token for all that meet the tokens beginning with text as `last` does; None if nothing can merge."""
        edge = self.merges.open_edge(last, text)
        return self.alike.setdefault((text, self.edges.setdefault(edge, len(self.edges))), last) if edge else None

    def run(self, text: str) -> list[int]:
        """The ids of the tokens of text."""
        if len(self.states) > self.max_states:
            self._clear()
        out: list[int] = []
        symbols = list(map(ord, text))
        state, steps, ends, mask = 0, self.steps, [], (1 << TOKEN_BITS) - 1
        for at in range(0, len(symbols) - 1, self.window):
            if at:
                self._emit_shared(state, ends, out)
            for symbol in symbols[at : min(at + self.window, len(symbols) - 1)]:
                step = steps.get(state << SYMBOL_BITS | symbol)
                if step is None:
                    step = self._step(state, symbol)
                state = step >> TOKEN_BITS
                ends.append(step & mask)
        if symbols:
            key = state << SYMBOL_BITS | symbols[-1]
            step = steps.get(key)
            if step is None and (step := self.lasts.get(key)) is None:
                step = self._last(state, symbols[-1])
            ends.append(step & mask)
        out += self._backwards(ends, len(ends))
        return out

    def _emit_shared(self, state: int, ends: list[int], out: list[int]) -> None:
        """Emits the tokens before all open places and drops what was held for them."""
        chains = [self._backwards(ends, len(ends) - len(self.places[place][0])) for place in self.states[state]]
        shared = 0
        while all(len(c) > shared and c[shared] == chains[0][shared] for c in chains):
            shared += 1
        out += chains[0][:shared]
        del ends[: sum(map(self.length.__getitem__, chains[0][:shared]))]

    def _backwards(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first `at` symbols, where ends has the last token of every prefix."""
        tokens, length = [], self.length
        while at:
            token = ends[at - 1]
            tokens.append(token)
            at -= length[token]
        tokens.reverse()
        return tokens


class PrefixCounts:
    """The number of tokens of every prefix of a word, by dynamic programming over last tokens.

    A prefix has one token more than the prefix before its last token. The last tokens are those of the transducer's
    transitions, so a symbol costs a look-up: of the state after it, and of the lengths of its last token if the text
    goes on and if it ends there. With word ends, the last symbol of a prefix counts as ended, as if the text stopped.
    """

    def __init__(self, merges: Merges, word_ends: bool, max_states: int):
        self.last, self.word_ends = Transducer(merges, max_states), word_ends
        self.lengths: dict[int, int] = {}  # state and symbol to the state after and both lengths

    def counts(self, text: str) -> list[int]:
        """Entry i: the token count of the first i + 1 symbols as a text of their own."""
        if len(self.last.states) > self.last.max_states:
            self.last._clear()
            self.lengths.clear()
        known, bits, mask = self.lengths, LENGTH_BITS, (1 << LENGTH_BITS) - 1
        state, end, inner, ended = 0, 0, [0], []
        for symbol in map(ord, text):
            step = known.get(state << SYMBOL_BITS | symbol)
            if step is None:
                step = self._lengths(state, symbol)
            end += 1
            ended.append(inner[end - (step & mask)] + 1)
            inner.append(inner[end - (step >> bits & mask)] + 1)
            state = step >> 2 * bits
        return ended

    def _lengths(self, state: int, symbol: int) -> int:
        machine = self.last
        step = machine._step(state, symbol)
        goes_on = machine.length[step & ((1 << TOKEN_BITS) - 1)]
        ends = machine.length[machine._last(state, symbol | END)] if self.word_ends else goes_on
        made = self.lengths[state << SYMBOL_BITS | symbol] = (step >> TOKEN_BITS) << 2 * LENGTH_BITS | goes_on << LENGTH_BITS | ends
        return made
