"""SentencePiece encoding, decoding and sampling of distinct segmentations without replacement.

``encode`` and ``decode`` run the tokenizer itself. ``sample_encodings`` draws ``k`` distinct segmentations of each
whole text, as subword regularisation does, by perturbed A-star search (Gumbel top-k):

The pieces that fit a text form a lattice, and every way through it is a segmentation whose probability is the product
of its pieces' weights. A search node is a prefix of a segmentation and stands for all segmentations that begin so. The
root's Gumbel value is drawn; of a node's children one inherits the node's value, the others get Gumbel values cut off
at it. The open node with the largest value is always the next to be completed, so complete segmentations come out in
the order of their perturbed log-probabilities: a sample without replacement. The value that comes next, of sample
k + 1, is the threshold from which inclusion probabilities follow.

Which child inherits does not depend on the value inherited. So the way from a node to a complete segmentation is one
walk drawn piece by piece, and the values of all nodes it leaves open follow afterwards, for a whole slice of texts at
once in numpy. Pieces never hold a blank after another character, so a lattice falls apart at blanks into words; words
are looked up and weighed once a slice, and texts share them.

All draws are hashes of the row's key, the sample's number, the place in the text and the piece's length, so a row
gets the same samples wherever and whenever it is read. A piece of merge rank r weighs ``(r + 2) ** -sharpness``; the
vocabulary holds ranks only. Characters the vocabulary lacks are spelled in bytes.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ballast.llm.texts import annotate, cached, hash_spans, slices, small_batches, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 1.0
SAMPLE_BYTES = 512 << 10
REACH = 44.0
BLANK = 0x2581
FIRST_PIECE = 259
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xBF58476D1CE4E5B9)
_E = np.uint64(0x94D049BB133111EB)
_STRIDE = np.uint64((64 * int(_C)) % 2**64)
NO = np.int64(-1)

SAMPLED = StructType(
    [
        StructField("sample", IntegerType()),
        StructField("ids", ArrayType(IntegerType())),
        StructField("log_prob", DoubleType()),
        StructField("perturbed", DoubleType()),
        StructField("inclusion", DoubleType()),
        StructField("log_inclusion", DoubleType()),
    ]
)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _D
    x = (x ^ (x >> np.uint64(27))) * _E
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, place: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Uniform in (0, 1), a hash of a seed and of where in a text it is drawn for which length."""
    return _unit(seed + (place.astype(np.uint64) * np.uint64(64) + np.asarray(length).astype(np.uint64)) * _C)


def _unit(x: np.ndarray) -> np.ndarray:
    h = _scramble(x)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _seeds(keys: list[str], rounds: int) -> np.ndarray:
    """A seed for each row and sample, apart from the next by far more than any text is long."""
    base = np.array([xxhash.xxh64_intdigest(x, 7) for x in keys], dtype=np.uint64)
    return _scramble(base + np.array([rounds + 1], dtype=np.uint64) * _E)


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c.astype(np.uint64) + np.uint64(1)) * _C
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Hashed prefixes of all pieces, with the piece that ends there, if any."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.processor.vocab_size()
        ranks = np.zeros(size)
        found: dict[str, int] = {}
        for i in range(FIRST_PIECE, size):
            piece = self.processor.id_to_piece(i)
            if any(a != "▁" and b == "▁" for a, b in zip(piece, piece[1:])):
                raise ValueError(f"piece {piece!r} crosses a blank")
            ranks[i] = i - FIRST_PIECE
            for end in range(1, len(piece)):
                found.setdefault(piece[:end], -1)
            found[piece] = i
        self.weight = -np.log(ranks + 2)
        self.bytes = np.array([self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.byte_weight = -np.log(size)
        self.longest = max(map(len, found))
        self.bits = np.uint64(64 - int(np.ceil(np.log2(len(found) * 4))))
        slots = 1 << (64 - int(self.bits))
        self.key = np.zeros(slots, dtype=np.uint64)
        self.piece = np.full(slots, -2, dtype=np.int32)
        texts = list(found)
        sizes = np.array([len(t) for t in texts])
        chars = np.zeros((len(texts), self.longest), dtype=np.int64)
        for i, t in enumerate(texts):
            chars[i, : len(t)] = [ord(c) for c in t]
        h = np.zeros(len(texts), dtype=np.uint64)
        for at in range(self.longest):
            live = sizes > at
            h[live] = _roll(h[live], chars[live, at])
        if len(np.unique(h)) < len(h) or not h.all():
            raise ValueError("two prefixes share a hash")
        taken: set[int] = set()
        for i, slot in enumerate(((h * _C) >> self.bits).tolist()):
            while slot in taken:
                slot = (slot + 1) % slots
            taken.add(slot)
            self.key[slot], self.piece[slot] = h[i], found[texts[i]]

    def look(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 for a mere prefix, -2 where nothing begins so."""
        slot = ((h * _C) >> self.bits).view(np.int64)
        key = self.key.take(slot)
        out = np.where(key == h, self.piece.take(slot), np.int32(-2))
        open_ = np.flatnonzero((key != h) & (key != 0))
        slot, want = slot.take(open_), h.take(open_)
        while len(open_):
            slot = (slot + 1) & (len(self.key) - 1)
            key = self.key.take(slot)
            same = np.flatnonzero(key == want)
            out[open_.take(same)] = self.piece.take(slot.take(same))
            on = np.flatnonzero((key != want) & (key != 0))
            open_, slot, want = open_.take(on), slot.take(on), want.take(on)
        return out


class Spelling:
    """The bytes every id stands for, end to end, to put texts together by."""

    def __init__(self, processor):
        spelled = []
        for i in range(processor.vocab_size()):
            if processor.is_byte(i):
                spelled.append(bytes([int(processor.id_to_piece(i)[3:-1], 16)]))
            elif processor.is_control(i):
                spelled.append(b"")
            elif processor.is_unknown(i):
                spelled.append(processor.decode([i]).encode())
            else:
                spelled.append(processor.id_to_piece(i).replace("▁", " ").encode())
        self.spelled = pa.array(spelled, pa.large_binary())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts whose ids end at ``ends``, end to end, and where each text ends. The blank that encoding
        puts before a text is left out."""
        put = self.spelled.take(pa.array(ids))
        through = np.frombuffer(put.buffers()[1], dtype=np.int64)
        out = np.frombuffer(put.buffers()[2] or b"", dtype=np.uint8)[: through[len(ids)]]
        stops = through[ends]
        starts = np.r_[0, stops[:-1]] if len(stops) else stops
        led = starts[stops > starts]
        led = led[out[led] == 0x20]
        kept = np.ones(len(out), dtype=bool)
        kept[led] = False
        return out[kept], stops - np.searchsorted(led, stops)


def spelling_of(model: str) -> Spelling:
    return cached(f"spelling {model}", lambda: Spelling(pieces_of(model).processor))


def _decoded_columns(data: np.ndarray, ends: np.ndarray, wanted: tuple[str, ...]) -> list[pa.Array]:
    out = []
    for name in wanted:
        if name == "decoded":
            offsets = pa.py_buffer(np.r_[0, ends].astype(np.int64))
            out.append(pa.LargeStringArray.from_buffers(len(ends), offsets, pa.py_buffer(data)).cast(pa.string()))
        else:
            whole, at = memoryview(data), [0, *ends.tolist()]
            out.append(pa.array([sha256(whole[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()))
    return out


def pieces_of(model: str) -> Pieces:
    return cached(f"sentencepiece {model}", lambda: Pieces(model))


class Lattice:
    """Arcs out of every character of some words, with the log-probability of each among its character's arcs."""

    def __init__(self, pieces: Pieces, chars: np.ndarray, left: np.ndarray, sharpness: float):
        """``left`` counts the characters from each one to its word's end, itself included."""
        n = len(chars)
        # Characters by their distance to the word's end: those with room for a length are the last of them, and the
        # arcs out of one distance lie together.
        far = np.cumsum(np.bincount(left, minlength=pieces.longest + 1))
        order = np.argsort(left.astype(np.uint16) if len(far) <= 1 << 16 else left, kind="stable")
        rank, at, h = np.arange(n), order, np.zeros(n, dtype=np.uint64)
        many = np.ones(n, dtype=np.int64)
        found = []
        for length in range(1, pieces.longest + 1):
            cut = np.searchsorted(rank, far[length - 1])
            rank, at, h = rank[cut:], at[cut:], h[cut:]
            if not len(rank):
                break
            own = chars.take(at)
            h = _roll(h, own)
            got = pieces.look(h)
            on = np.flatnonzero(got > -2)
            if length == 1:
                spelled = np.where(own < 128, pieces.bytes[np.minimum(own, 127)], NO)
                found.append((rank, np.where(got >= 0, got, spelled)))
            else:
                hit = np.flatnonzero(got >= 0)
                where = rank.take(hit)
                many[where] += 1
                found.append((where, got.take(hit)))
            rank, at, h = rank.take(on), at.take(on) + 1, h.take(on)
        # Arcs by character, the longest first, as it is the likeliest. A length gives a character one arc at most.
        ends = np.cumsum(many)
        first = ends - many
        total = int(ends[-1]) if n else 0
        self.length, self.piece = np.ones(total, dtype=np.int16), np.empty(total, dtype=np.int32)
        free = first.copy()
        for length in range(len(found), 1, -1):
            where, piece = found[length - 1]
            slot = free.take(where)
            free[where] = slot + 1
            self.length[slot], self.piece[slot] = length, piece
        if found:
            self.piece[free] = found[0][1]
        weight = pieces.weight.take(self.piece, mode="wrap")
        odd = np.flatnonzero(self.piece < FIRST_PIECE)
        own = chars.take(order.take(np.searchsorted(ends, odd, "right")))
        weight[odd] = (1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)) * pieces.byte_weight
        weight *= sharpness
        # From the end of each word backwards: the log of the summed weights of all ways from here. After each word's
        # places comes one for its end.
        spot = (np.arange(n) + np.cumsum(left == 1) - (left == 1)).take(order)
        to = np.repeat(spot, many) + self.length
        rest = np.zeros(n + (int(far[1]) if n else 0))
        self.log_prob = np.empty(total)
        bounds = far.tolist()
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if begin == end:
                continue
            a, b = int(first[begin]), int(ends[end - 1])
            own = many[begin:end]
            starts = first[begin:end] - a
            score = weight[a:b] + rest.take(to[a:b])
            top = np.maximum.reduceat(score, starts)
            total = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, own)), starts))
            rest[spot[begin:end]] = total
            self.log_prob[a:b] = score - np.repeat(total, own)
        self.prob = np.exp(self.log_prob)
        self.first, self.count = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        self.first[order], self.count[order] = first, many


def _expand(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


class Slice:
    """The texts of a slice as characters, their words, and the lattice of the distinct words."""

    def __init__(self, pieces: Pieces, texts: list[str], sharpness: float):
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        self.chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        self.begin = np.cumsum(sizes) - sizes
        n = len(self.chars)
        blank = self.chars == BLANK
        starts = blank & ~np.r_[False, blank[:-1]] if n else np.zeros(0, bool)
        starts[self.begin[sizes > 0]] = True
        self.word = np.flatnonzero(starts)
        self.word_end = np.r_[self.word[1:], n] if len(self.word) else self.word
        # Words follow each other without gaps; those of each text, and each one's text.
        self.first_word = np.searchsorted(self.word, np.r_[self.begin, n])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first_word))
        words = self._distinct()
        shapes = self.word_end[words] - self.word[words]
        place = _expand(self.word[words], shapes)
        base = np.cumsum(shapes) - shapes
        left = np.repeat(shapes, shapes) - (np.arange(len(place)) - np.repeat(base, shapes))
        self.lattice = Lattice(pieces, self.chars.take(place).astype(np.int64), left, sharpness)
        # Where a character's copy in the lattice is: that of its word, moved.
        self.shift = base[self.same] - self.word

    def _distinct(self) -> np.ndarray:
        """One word of each spelling; ``same`` gives each word's among them."""
        if not len(self.word):
            self.same = np.zeros(0, np.int64)
            return self.same
        short = self.chars.astype("<u2") if self.chars.max() < 1 << 16 else self.chars
        h = hash_spans(short.view(np.uint8), self.word * short.itemsize, self.word_end * short.itemsize)
        order = np.argsort(h)
        new = np.diff(h[order], prepend=~h[order[:1]]) != 0
        firsts = order[new]
        self.same = np.empty(len(h), dtype=np.int64)
        self.same[order] = np.cumsum(new) - 1
        alike = self.word[firsts][self.same]
        size = self.word_end - self.word
        if (size != size[firsts][self.same]).any() or (
            short != short.take(np.arange(len(short)) + np.repeat(alike - self.word, size))
        ).any():
            raise ValueError("two words share a hash")
        return firsts


def _walk(s: Slice, seed: np.ndarray, begin: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, arc, word) of a random way through each word from its place ``begin`` to its end."""
    lat = s.lattice
    which = np.flatnonzero(begin < s.word_end[word])
    at, shift = begin[which], s.shift[word[which]]
    own, stop = at + shift, s.word_end[word[which]] + shift
    text = s.text[word[which]]
    x = seed[text] + (at - s.begin[text]).astype(np.uint64) * _STRIDE
    steps = []
    while len(own):
        u = _unit(x)
        pick = lat.first.take(own)
        below = lat.prob.take(pick)
        on = np.flatnonzero(u >= below)
        now = pick.take(on)
        last = now + lat.count.take(own.take(on)) - 1
        draw, below = u.take(on), below.take(on)
        more = np.flatnonzero(now < last)
        while len(more):
            on, now, last, draw = on.take(more), now.take(more) + 1, last.take(more), draw.take(more)
            below = below.take(more) + lat.prob.take(now)
            pick[on] = now
            more = np.flatnonzero((draw >= below) & (now < last))
        steps.append((which, own, pick))
        size = lat.length.take(pick)
        own = own + size
        live = np.flatnonzero(own < stop)
        x = x.take(live) + size.take(live).astype(np.uint64) * _STRIDE
        which, own, stop = which.take(live), own.take(live), stop.take(live)
    many = np.zeros(len(word), dtype=np.int64)
    for i, (which, _, _) in enumerate(steps):
        many[which] = i + 1
    first = np.cumsum(many) - many
    place, arc = np.empty(many.sum(), dtype=np.int64), np.empty(many.sum(), dtype=np.int64)
    for i, (which, own, pick) in enumerate(steps):
        slot = first.take(which) + i
        place[slot], arc[slot] = own, pick
    return place - np.repeat(s.shift[word], many), arc, np.repeat(word, many)


def sample_slice(pieces: Pieces, texts: list[str], keys: list[str], k: int, sharpness: float) -> list[list[tuple]]:
    """For each text up to ``k`` samples (ids, log_prob, perturbed, inclusion, log_inclusion), the best first."""
    s = Slice(pieces, texts, sharpness)
    lat, n = s.lattice, len(texts)
    root = -np.log(-np.log(_uniform(_seeds(keys, -1), np.zeros(n, dtype=np.int64), 0)))
    out: list[list] = [[] for _ in range(n)]
    # Open nodes of each text: (value, log-probability, sample it leaves, steps before it, place, arc)
    open_: list[list[tuple]] = [[] for _ in range(n)]
    paths: list[list[tuple]] = [[] for _ in range(n)]
    start = [(t, float(root[t]), 0.0, None, 0, int(s.begin[t]), -1) for t in range(n)]
    for rounds in range(k + 1):
        if not start:
            break
        if rounds == k:  # only the threshold is asked for
            for t, value, phi, *_ in start:
                out[t].append([phi, value])
            break
        seed = _seeds(keys, rounds)
        # Where the walk of each text begins: at a word's place, then all words after it.
        who = np.array([x[0] for x in start])
        at = np.array([x[5] for x in start])
        taken = [int(lat.length[x[6]]) if x[6] >= 0 else 0 for x in start]
        words = np.searchsorted(s.word, at, "right") - 1
        left = np.where(s.first_word[who] < s.first_word[who + 1], s.first_word[who + 1] - words, 0)
        word = _expand(words, left)
        begin = s.word[word]
        begin[(np.cumsum(left) - left)[left > 0]] = (at + taken)[left > 0]
        place, arc, word = _walk(s, seed, begin, word)
        text = s.text[word]
        lo, hi = np.searchsorted(text, who, "left"), np.searchsorted(text, who, "right")
        value, before = np.zeros(n), np.zeros(n)
        for t, g, phi, *_ in start:
            value[t], before[t] = g, phi
        step = lat.log_prob[arc]
        run = np.cumsum(step) - step
        if len(place):
            opens = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            run = run - np.repeat(run[opens], np.diff(np.r_[opens, len(text)])) + before[text]
        # A Gumbel value exceeds its log-probability by 38 at most, as draws have 53 bits: nodes of far lower
        # log-probability than the others are weighed only where those do not give enough.
        near = _siblings(s, seed, value, word, place, arc, run, run > -REACH)
        enough = np.bincount(near[0][near[2] > 38.0 - REACH], minlength=n) >= k - rounds
        t_of, of, g, phi, sib = near
        if not enough[who].all():
            far = _siblings(s, seed, value, word, place, arc, run, (run <= -REACH) & ~enough[text])
            t_of, of, g, phi, sib = (np.concatenate(x) for x in zip(near, far))
            order = np.argsort(t_of, kind="stable")
            t_of, of, g, phi, sib = t_of[order], of[order], g[order], phi[order], sib[order]
        # No more than what is still to come can be popped from the nodes of this round.
        need = k - rounds
        s_lo, s_hi = np.searchsorted(t_of, who, "left"), np.searchsorted(t_of, who, "right")
        following = []
        for j, (t, own_value, own_phi, parent, kept, _, taken) in enumerate(start):
            a, b = int(lo[j]), int(hi[j])
            logp = float(run[b - 1] + step[b - 1]) if b > a else own_phi
            paths[t].append((parent, kept, taken, arc[a:b]))
            out[t].append([logp, own_value])
            if not need:
                continue
            c, d = int(s_lo[j]), int(s_hi[j])
            gs = g[c:d]
            best = np.argpartition(-gs, need)[:need] if len(gs) > need else np.arange(len(gs))
            base_steps = (kept + (taken >= 0)) if parent is not None else 0
            for i in best.tolist():
                f = int(of[c + i])
                open_[t].append((float(gs[i]), float(phi[c + i]), len(paths[t]) - 1, base_steps + f - a, int(place[f]), int(sib[c + i])))
            if open_[t]:
                best_i = max(range(len(open_[t])), key=lambda i: open_[t][i][0])
                v, p, par, steps, pl, ar = open_[t].pop(best_i)
                following.append((t, v, p, par, steps, pl, ar))
        start = following
    result: list[list[tuple]] = []
    for t in range(n):
        arcs: list[np.ndarray] = []
        rows = []
        kappa = out[t][k][1] if len(out[t]) > k else None
        for i, (parent, kept, taken, tail) in enumerate(paths[t][:k]):
            full = tail if parent is None else np.concatenate([arcs[parent][:kept], [taken], tail])
            arcs.append(full)
            logp, value = out[t][i]
            over = 700.0 if kappa is None else min(logp - kappa, 700.0)
            inclusion = float(-np.expm1(-np.exp(over)))
            rows.append((_ids(pieces, s, t, full), logp, value, inclusion, float(np.log(inclusion)) if over > -30 else over))
        result.append(rows)
    return result


def _siblings(s: Slice, seed, value, word, place, arc, run, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, step, value, log-probability, arc) of the nodes left open at the chosen steps of a walk."""
    lat = s.lattice
    steps = np.flatnonzero(chosen)
    own = place[steps] + s.shift[word[steps]]
    many = lat.count[own]
    sib = _expand(lat.first[own], many)
    other = np.flatnonzero(sib != np.repeat(arc[steps], many))
    sib, of = sib.take(other), np.repeat(steps, many).take(other)
    text = s.text[word[of]]
    phi = run[of] + lat.log_prob[sib]
    u = _uniform(seed[text], place[of] - s.begin[text], lat.length[sib])
    g = phi - np.log(np.exp(np.minimum(phi - value[text], 700)) - np.log(u))
    return text, of, g, phi, sib


def _ids(pieces: Pieces, s: Slice, text: int, arcs: np.ndarray) -> np.ndarray:
    ids = s.lattice.piece[arcs]
    if (ids >= 0).all():
        return ids.astype(np.int32)
    ends = np.cumsum(s.lattice.length[arcs])
    starts = ends - s.lattice.length[arcs] + s.begin[text]
    out: list[int] = []
    for i, piece in enumerate(ids.tolist()):
        out += [piece] if piece >= 0 else pieces.bytes[list(chr(s.chars[starts[i]]).encode())].tolist()
    return np.array(out, dtype=np.int32)


def sample_encodings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str = MODEL,
    sharpness: float = SHARPNESS, decode_to: tuple[str, ...] = (),
) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of each text, a row each: the input's columns but the text, then
    ``sample`` (from 1, the largest perturbed log-probability first), ``ids``, ``log_prob``, ``perturbed`` and
    ``inclusion``, the probability of being among the ``k`` given the threshold that was drawn, with its logarithm in
    ``log_inclusion``, as that of a long text's sample is too small for a double.

    A text with fewer segmentations gives all of them, with inclusion 1. An empty or null text has one, without ids.
    Rows with equal keys and texts get equal samples; a null key is a key of its own. Texts of any length are sampled
    whole; a long one takes memory and time in proportion to it.

    ``decode_to`` adds what the ids of each sample decode to, put together where they were drawn: ``decoded``, the text,
    ``decoded_sha256``, its SHA-256 in hex, or both.
    """
    if not set(decode_to) <= {"decoded", "decoded_sha256"}:
        raise ValueError("decode_to takes decoded and decoded_sha256")
    small_batches(docs.sparkSession)
    added = StructType([*SAMPLED, *[StructField(n, StringType()) for n in decode_to]])
    kept = [c for c in docs.columns if c != text and c not in added.fieldNames()]
    schema = with_columns(docs.drop(text).schema, added)

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for part in slices(batch, text, SAMPLE_BYTES):
                texts = pc.fill_null(part.column(text), "").to_pylist()
                keys = [str(x) for x in part.column(key).to_pylist()]
                rows = sample_slice(pieces, texts, keys, k, sharpness)
                counts = np.array([len(r) for r in rows])
                take = pa.array(np.repeat(np.arange(len(rows)), counts))
                flat = [r for own in rows for r in own]
                sizes = np.cumsum([0, *[len(r[0]) for r in flat]])
                values = np.concatenate([r[0] for r in flat]) if flat else np.zeros(0, np.int32)
                new = [
                    pa.array([i + 1 for c in counts.tolist() for i in range(c)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32())),
                    *[pa.array([r[i] for r in flat], pa.float64()) for i in (1, 2, 3, 4)],
                ]
                if decode_to:
                    new += _decoded_columns(*spelling_of(model).texts(values, sizes[1:]), decode_to)
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in kept] + new, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Add the tokenizer's own encoding of each text. Null and empty texts have no ids."""

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.fill_null(part.column(text), "").to_pylist()
        return [pa.array(pieces_of(model).processor.encode(texts, num_threads=1), pa.list_(pa.int32()))]

    return annotate(docs, StructType([StructField(ids, ArrayType(IntegerType()))]), text, run)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of each row's ids. No ids, or null, give an empty text."""
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != text]
    schema = with_columns(rows.schema, StructType([StructField(text, StringType())]))

    def run(batches):
        for batch in batches:
            lists = [list(x) if x else [] for x in batch.column(ids).to_pylist()]
            texts = pieces_of(model).processor.decode(lists, num_threads=1) if lists else []
            new = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [new], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
