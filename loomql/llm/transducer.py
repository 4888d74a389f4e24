"""A SentencePiece model compiled to a weighted transducer, and its shortest paths, in arrays.

The machine is the composition of four parts:

* normaliser: the model's character rules (longest match first, else a character stands for itself), its
  treatment of white space, a space as U+2581, and the dummy prefix;
* pieces: a trie with one path a piece, reading its characters, writing its id, weighing its negated score;
* byte fallback: a character without a piece goes through one arc for each of its UTF-8 bytes;
* merge constraint: the state after an arc is the piece it wrote, and an arc for piece ``q`` leaves state
  ``p`` only if the merges that built ``p`` and ``q`` would not also have joined the two.  A sequence of
  pieces is what the model's merge order yields exactly when each adjacent pair is (the first merge
  that crossed a boundary would cross it in that pair alone as well), so for a merge model the accepted
  path is the library's own segmentation; a unigram model has no such constraint.

``shortest_paths`` composes the machine with many inputs at once: all arcs of a block of inputs come from one walk
of the trie over their characters, and the tropical-semiring (min, +) forward pass goes through the
inputs side by side, place by place.  Where two characters stand next to each other in no piece,
inputs fall apart, so the pass is as long as the longest part; parts of more than ``LONG`` characters are passed
one by one.  One state a place is enough: with the constraint no place can be reached in two states, without it the
least one dominates.  Inside the machine a space stands for U+2581.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = np.int64(1) << 40
#: Characters of a block of inputs, and of a part that is passed by itself.
BLOCK, LONG = 1 << 16, 512


class Pairs:
    """An immutable map from pairs of small integers to integers, looked up for whole arrays (open addressing)."""

    def __init__(self, first: np.ndarray, second: np.ndarray, values: np.ndarray, missing: int):
        self.missing = missing
        self.bits = max(4, int(2 * len(first)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, missing, np.int64)
        key = first.astype(np.int64) << 32 | second.astype(np.int64)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            at, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[at], self.values[at] = key[placed], values[placed]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first.astype(np.int64) << 32 | second.astype(np.int64)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], self.missing)
        left = np.flatnonzero((held != key) & (held != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != -1)]
        return out


def character_rules(compiled: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8 bytes whose leaves point into a list of texts."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, texts = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64), compiled[4 + size :]
    jump = lambda u: u >> 10 << ((u & 0x200) >> 6)
    rules: dict[str, str] = {}
    labels = np.arange(1, 256)
    at, read = jump(units[:1]), [b""]
    while len(at):
        to = at[:, None] ^ labels[None, :]
        ok = (to < len(units)) & (units[np.minimum(to, len(units) - 1)] & 0x800000FF == labels[None, :])
        parent, label = np.nonzero(ok)
        to = to[parent, label]
        read = [read[p] + bytes([b + 1]) for p, b in zip(parent.tolist(), label.tolist())]
        unit = units[to]
        at = to ^ jump(unit)
        for i in np.flatnonzero(unit >> 8 & 1).tolist():
            start = int(units[at[i]] & 0x7FFFFFFF)
            rules[read[i].decode()] = texts[start : texts.index(b"\0", start)].decode()
    return rules


class Normaliser:
    """The model's rewriting of a text before it is cut into pieces."""

    def __init__(self, spec):
        self.rules = character_rules(spec.precompiled_charsmap)
        self.longest: dict[str, int] = {}
        for rule in self.rules:
            self.longest[rule[0]] = max(self.longest.get(rule[0], 0), len(rule))
        self.strip, self.prefix = spec.remove_extra_whitespaces, spec.add_dummy_prefix
        if not spec.escape_whitespaces:
            raise ValueError("models that keep spaces as they are are not compiled")

    def rewritten(self, text: str) -> str:
        """``text`` with each longest match of a rule replaced, from left to right."""
        if not self.rules:
            return text
        out, i, n = [], 0, len(text)
        while i < n:
            for k in range(min(self.longest.get(text[i], 0), n - i), 0, -1):
                if (new := self.rules.get(text[i : i + k])) is not None:
                    out.append(new)
                    i += k
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        """The text with its spaces settled; U+2581 itself is one more space from here on."""
        text = self.rewritten(text)
        if self.strip:
            text = " ".join([w for w in text.split(" ") if w])
        if not text:
            return ""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        text = " " + text if self.prefix else text
        return text.rstrip(" ") if self.strip else text


class Transducer:
    """A compiled model: ``normalise``, ``shortest_paths`` and ``decode``."""

    def __init__(self, model):
        from sentencepiece import sentencepiece_model_pb2 as pb

        if isinstance(model, str):
            with open(model, "rb") as file:
                model = file.read()
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models with byte fallback, spaces before words and no denormaliser are compiled")
        self.normalise = Normaliser(proto.normalizer_spec)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.strip = proto.normalizer_spec.remove_extra_whitespaces
        self.constrained = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.byte_id = np.zeros(256, np.uint32)
        self.bytes_of: list[bytes] = []
        ids: dict[str, int] = {}
        weight: dict[str, float] = {}
        for i, piece in enumerate(proto.pieces):
            raw = b""
            if piece.type == NORMAL:
                text = piece.piece.replace(SPACE, " ")
                ids[text], weight[text] = i, -piece.score
                raw = text.encode()
            elif piece.type == BYTE:
                raw = bytes([int(piece.piece[1:-1], 16)])
                self.byte_id[raw[0]] = i
            elif piece.type in (USER, UNUSED):
                raise ValueError("user-defined and unused pieces are not compiled")
            self.bytes_of.append(raw)
        if any(" " in p.lstrip(" ") for p in ids):
            raise ValueError("a piece crosses a word boundary")
        self._compile(ids, weight)

    # --- compilation
    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """(segments of ``text`` by the merge order: cheapest joined piece first, leftmost on a tie; the last two that were joined)."""
        weight, parts, last = self._weights, list(text), ("", "")
        while len(parts) > 1:
            found = [(weight[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in weight]
            if not found:
                break
            i = min(found)[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _compile(self, ids: dict[str, int], weight: dict[str, float]) -> None:
        """Number the symbols (pieces that can occur, and single characters) and lay out trie, joins and ranks as arrays."""
        self._weights = weight
        self._plain: dict = {}
        built: dict[str, tuple[str, str]] = {}
        if self.constrained:
            for p in ids:
                parts, last = self.merged(p)
                if len(parts) == 1:
                    built[p] = last
        else:
            built = dict.fromkeys(ids, ("", ""))
        characters = sorted({c for p in ids for c in p})
        self.symbols = [*built, *[c for c in characters if c not in built]]
        number = {s: k for k, s in enumerate(self.symbols)}
        self.id_of = np.array([ids.get(s, -1) for s in self.symbols], np.int64)
        penalty = max(weight.values(), default=0.0) + 10.0  # of a character that only bytes can write
        self.weight = np.array([weight.get(s, 0.0 if self.constrained else penalty) for s in self.symbols])
        self.length = np.array([len(s) for s in self.symbols], np.int64)
        self.letter = np.zeros(0x110000, np.uint16 if len(characters) < 65535 else np.uint32)
        self.letter[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        code = {c: k for k, c in enumerate(characters, 1)}
        inner = {pair for p in ids for pair in zip(p, p[1:])}
        self.inner = Pairs(*self._columns([(code[a], code[b], 1) for a, b in inner]), 0)
        # merge order: rank of each symbol (characters stand before all), the two symbols that it was built from, and what two symbols join to
        order = {w: k for k, w in enumerate(sorted(set(weight.values())))}
        single = [len(s) == 1 for s in self.symbols]
        self.rank = np.array([-1 if one else order[weight[s]] for s, one in zip(self.symbols, single)], np.int64)
        self.left = np.array([number[built[s][0]] if built.get(s, ("", ""))[0] else -1 for s in self.symbols], np.int64)
        self.right = np.array([number[built[s][1]] if built.get(s, ("", ""))[1] else -1 for s in self.symbols], np.int64)
        joins = [(number[p[:k]], number[p[k:]], order[w]) for p, w in weight.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number] if self.constrained else []
        self.joins = Pairs(*self._columns(joins), int(_NEVER))
        # the trie: state 0 is its root
        states, steps = {"": 0}, []
        for s in self.symbols:
            for k in range(1, len(s) + 1):
                if s[:k] not in states:
                    states[s[:k]] = len(states)
                    steps.append((states[s[: k - 1]], code[s[k - 1]], states[s[:k]]))
        self.trie = Pairs(*self._columns(steps), 0)
        self.ends = np.full(len(states), -1, np.int64)
        self.ends[[states[s] for s in self.symbols]] = np.arange(len(self.symbols))

    @staticmethod
    def _columns(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = np.array(rows, np.int64).reshape(len(rows), 3)
        return table[:, 0], table[:, 1], table[:, 2]

    # --- the merge constraint
    def follows(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether an arc for symbol ``q`` may leave the state of symbol ``p``, for arrays of either.

        The merges that built the two are undone from the last one on, along the edge where they meet; the constraint
        fails if what stands there would have been joined before the merge that was undone last.
        """
        ok = np.ones(len(p), bool)
        live, limit = np.arange(len(p)), np.full(len(p), _NEVER)
        a, b = p.copy(), q.copy()
        while len(live):
            bad = self.joins.get(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            later = rb >= ra  # of equal ranks the left one merges first, so the right one is undone first
            limit = np.where(later, rb + 1, ra)
            a, b = np.where(later, a, self.right[a]), np.where(later, self.left[b], b)
        return ok

    # --- composition and shortest path
    def _arcs(self, letters: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, symbol) of every arc: the trie walked from every character, up to the end ``stop`` of its part."""
        starts, symbols = [], []
        at = np.flatnonzero(letters > 0)
        state, here = np.zeros(len(at), np.int64), at.copy()
        while len(at):
            state = self.trie.get(state, letters[here])
            on = state > 0
            at, here, state = at[on], here[on] + 1, state[on]
            symbol = self.ends[state]
            found = symbol >= 0
            starts.append(at[found])
            symbols.append(symbol[found])
            on = here < stop[at]
            at, here, state = at[on], here[on], state[on]
        return (np.concatenate(starts), np.concatenate(symbols)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def shortest_paths(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids of the least path of each normalised text, the paths' weights)."""
        ids: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        at = held = 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= BLOCK or k + 1 == len(texts):
                found = self._block(texts[at : k + 1])
                ids += found[0]
                weights.append(found[1])
                at, held = k + 1, 0
        return ids, np.concatenate(weights) if weights else np.empty(0)

    def _block(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum())
        if n == 0:
            return [np.empty(0, np.uint32) for _ in texts], np.zeros(len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[points].astype(np.int64)
        offsets = np.cumsum(sizes) - sizes
        first = np.zeros(n + 1, bool)  # where a part begins
        first[offsets[sizes > 0]] = first[0] = first[n] = True
        first[1:n] |= self.inner.get(letters[:-1], letters[1:]) == 0
        begins = np.flatnonzero(first)
        length = np.diff(begins)
        part = np.repeat(np.arange(len(length)), length)
        start, symbol = self._arcs(letters, begins[part + 1])
        state, weight = np.full(n + 1, -1, np.int64), np.full(n + 1, np.inf)  # by the end of the last arc; where parts meet, the state is the left one's
        long = length[part[start]] > LONG
        for k in np.flatnonzero(length > LONG):
            mine = long & (part[start] == k)
            self._pass_alone(start[mine], symbol[mine], int(begins[k]), int(begins[k + 1]), state, weight)
        if long.any():
            start, symbol = start[~long], symbol[~long]
        place = (start - begins[part[start]]).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        start, symbol, place = start[order], symbol[order], place[order]
        bounds = np.searchsorted(place, np.arange(int(place[-1]) + 2)) if len(place) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            s, q = start[lo:hi], symbol[lo:hi]
            opening = lo == 0
            if not opening:
                p = state[s]
                ok = p >= 0
                s, q, p = s[ok], q[ok], p[ok]
                if self.constrained:
                    ok = self.follows(p, q)
                    s, q = s[ok], q[ok]
            w, end = self.weight[q] + (0.0 if opening else weight[s]), s + self.length[q]
            if not self.constrained:
                least = np.lexsort((w, end))
                least = least[np.r_[True, end[least][1:] != end[least][:-1]]] if len(least) else least
                least = least[w[least] < weight[end[least]]]
                q, w, end = q[least], w[least], end[least]
            state[end], weight[end] = q, w
        # back from the ends of all parts, side by side
        known = letters[begins[:-1]] > 0
        ends, froms = begins[1:][known], begins[:-1][known]
        at = np.full(n, -2, np.int64)  # the symbol that begins at a place of the path; -1: bytes
        at[letters == 0] = -1
        while len(ends):
            q = state[ends]
            ends = ends - self.length[q]
            at[ends] = q
            on = ends > froms
            ends, froms = ends[on], froms[on]
        place = np.flatnonzero(at > -2)
        q = at[place]
        values, of = self._with_bytes(np.where(q >= 0, self.id_of[q], -1), points[place])
        cuts = np.searchsorted(place[of], np.r_[offsets, n])
        ended = np.where(first[1:] & (weight[1:] < np.inf), weight[1:], 0.0)
        total = np.cumsum(np.r_[0.0, ended])
        return [values[a:b] for a, b in zip(cuts, cuts[1:])], total[offsets + sizes] - total[offsets]

    def _pass_alone(self, start: np.ndarray, symbol: np.ndarray, begin: int, end: int, state: np.ndarray, weight: np.ndarray) -> None:
        """The forward pass through one long part, place by place."""
        if not self._plain:
            full = self.joins.keys >= 0
            self._plain = {"joins": dict(zip(self.joins.keys[full].tolist(), self.joins.values[full].tolist())), "rank": self.rank.tolist(), "left": self.left.tolist(), "right": self.right.tolist(), "length": self.length.tolist(), "weight": self.weight.tolist()}
        joins, rank, left, right = (self._plain[x] for x in ("joins", "rank", "left", "right"))
        lengths, weights = self._plain["length"], self._plain["weight"]

        def follows(a: int, b: int) -> bool:
            limit = int(_NEVER)
            while True:
                if joins.get(a << 32 | b, limit) < limit:
                    return False
                ra, rb = rank[a], rank[b]
                if ra < 0 and rb < 0:
                    return True
                if rb >= ra:
                    limit, b = rb + 1, left[b]
                else:
                    limit, a = ra, right[a]

        order = np.argsort(start, kind="stable")
        arcs = symbol[order].tolist()
        bounds = np.searchsorted(start[order], np.arange(begin, end + 1)).tolist()
        states, least = [-1] * (end - begin + 1), [float("inf")] * (end - begin + 1)
        least[0] = 0.0
        for k in range(end - begin):
            p, here = states[k], least[k]
            if k and p < 0:
                continue
            for q in arcs[bounds[k] : bounds[k + 1]]:
                to = k + lengths[q]
                if here + weights[q] < least[to] and (not k or not self.constrained or follows(p, q)):
                    states[to], least[to] = q, here + weights[q]
        state[begin + 1 : end + 1], weight[begin + 1 : end + 1] = states[1:], least[1:]

    def _with_bytes(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the UTF-8 bytes of each character that has none, and the row that each one came from."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids.astype(np.uint32), np.arange(len(ids))
        raw = [chr(c).encode("utf-8", "replace") for c in points[bare].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[bare] = [len(r) for r in raw]
        of = np.repeat(np.arange(len(ids)), counts)
        out = ids[of]
        out[out < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.uint32), of

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that the normaliser put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        if self.strip:
            return raw.lstrip(" ")
        return raw.removeprefix(" ") if self.prefix else raw
