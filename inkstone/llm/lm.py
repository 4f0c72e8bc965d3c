"""Gated recurrent language model in numpy: truncated backpropagation, a class-factored output softmax, and a state that
is carried across windows, so that whole documents get their log-likelihood.

Words and one end are tokens. Counts cover all training documents. The `known` most frequent words' counts are a bounded
broadcast; counts of rarer ones are joined. The network tells apart the `head` most frequent words and, for all others,
one sign for each group of words that begin and end alike; a word's probability within its group is its smoothed share of
the group's count. So every token, known or not, has a probability, and those of all known tokens and of one unknown word
a group sum to one.
"""

import io
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, small_batches


@dataclass(frozen=True)
class Settings:
    head: int = 1024
    groups: int = 1024
    known: int = 1 << 17
    class_words: int = 48
    embedding: int = 12
    hidden: int = 16
    #: Training: documents side by side at most, tokens of a window, windows that a pass should have at least.
    lanes: int = 384
    window: int = 32
    passes: int = 100
    #: Each round trains replicas on one of the slices of the training documents and averages their weights.
    slices: int = 6
    #: Tokens that a replica is given and those that it holds at once; replicas at most; weights averaged by a task.
    replica_tokens: int = 1_500_000
    held_tokens: int = 2_000_000
    replicas: int = 8192
    fan: int = 64
    rate: float = 0.008
    #: Scoring: documents side by side, tokens of a window, tokens that a task gathers first.
    score_lanes: int = 256
    score_window: int = 64
    gather: int = 2_000_000


Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: The end's place among the counted words; no word is empty.
END = b""


#: Logits are held to this size, so that their exponentials and sums stay finite.
LARGEST = np.float32(60)
#: Bits of a group that a word's beginning sets; its end sets the others, which are the group's class.
START_BITS = 6


def group_of(word: bytes, groups: int) -> int:
    """Group of a word: by its last two bytes and its first two."""
    return (zlib.crc32(word[-2:]) << START_BITS | zlib.crc32(word[:2]) & (1 << START_BITS) - 1) % groups


def group_column(word: Column, groups: int) -> Column:
    """group_of() of a binary column."""
    end, start = F.crc32(F.substring(word, -2, 2)), F.crc32(F.substring(word, 1, 2))
    return ((end * (1 << START_BITS) + start % (1 << START_BITS)) % groups).cast("int")


def _softmax(logits: np.ndarray, chosen: np.ndarray, rows: np.ndarray, slopes: bool) -> np.ndarray:
    """Log-probability of each row's chosen column; with slopes the logits become the loss's slopes in place."""
    np.clip(logits, -LARGEST, LARGEST, out=logits)
    own = logits[rows, chosen]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    if slopes:
        logits *= (1 / total)[:, None]
        logits[rows, chosen] -= 1
    return own - np.log(total)


def _by_token(states: np.ndarray) -> np.ndarray:
    """[t, unit, lane] as a row for each t and lane."""
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])


class Network:
    """The recurrent network over head words 0..n-1 and the groups' signs from n on."""

    def __init__(self, counts: np.ndarray, settings: Settings, weights: Weights | None = None):
        """counts: of the head words, most frequent first, then of each group's other words together."""
        self.settings = settings
        self.head, self.size = len(counts) - settings.groups, len(counts)
        first = np.arange(self.head) // settings.class_words
        later = np.arange(settings.groups) // settings.class_words + (first[-1] + 1 if self.head else 0)
        self.class_of = np.r_[first, later].astype(np.uint16)  # sixteen bits are sorted by radix
        self.classes = int(self.class_of[-1]) + 1
        self.first = np.searchsorted(self.class_of, np.arange(self.classes + 1)).astype(np.int32)
        self.borders = self.first.tolist()
        self.widest = int(np.diff(self.first).max())
        self.weights = weights if weights is not None else self._start(counts.astype(float) + 1.0)
        self.mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        self.step = 0

    def _start(self, counts: np.ndarray) -> Weights:
        """Small random weights; the biases alone give the words' shares."""
        s, rng = self.settings, np.random.default_rng(7)
        total = np.bincount(self.class_of, weights=counts, minlength=self.classes)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        bias = np.zeros(3 * s.hidden, np.float32)
        bias[: s.hidden] = 1.0
        return {
            "embed": draw(self.size, s.embedding),
            "input": draw(s.embedding, 3 * s.hidden),
            "state": draw(s.hidden, 3 * s.hidden),
            "bias": bias,
            "class": draw(s.hidden, self.classes) * 0.1,
            "class_bias": np.log(total / total.sum()).astype(np.float32),
            "word": draw(self.size, s.hidden) * 0.1,
            "word_bias": np.log(counts / total[self.class_of]).astype(np.float32),
        }

    def run(self, ids: np.ndarray, keep: np.ndarray, state: np.ndarray, past: list | None = None) -> np.ndarray:
        """States before each of the tokens ids[t, lane], as [t, unit, lane]; keep is 0 where a document begins. state, a row
        a unit and a column a lane, is changed in place. past gets what backpropagation needs of each step."""
        w, n = self.weights, self.settings.hidden
        fed = np.ascontiguousarray((w["embed"] @ w["input"] + w["bias"])[ids].transpose(0, 2, 1))
        turn = np.ascontiguousarray(w["state"].T)
        out = np.empty((len(ids), n, ids.shape[1]), np.float32)
        for t in range(len(ids)):
            state *= keep[t]
            out[t] = state
            x, g = fed[t], turn @ state
            gates = x[: 2 * n]
            gates += g[: 2 * n]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:n], gates[n:]
            new = x[2 * n :]
            new += r * g[2 * n :]
            np.tanh(new, out=new)
            if past is not None:
                past.append((z, r, new, g[2 * n :]))
            state -= new
            state *= z
            state += new
        return out

    def log_p(self, states: np.ndarray, ids: np.ndarray, gradient: Weights | None = None) -> np.ndarray | tuple:
        """Natural log-probability of each id after its state; with gradient also adds to it, and gives the states'."""
        w = self.weights
        kind = self.class_of[ids]
        order = np.argsort(kind, kind="stable")
        states, ids, kind = states[order], ids[order], kind[order]
        rows = np.arange(len(ids))
        logits = states @ w["class"]
        logits += w["class_bias"]
        logs = _softmax(logits, kind, rows, gradient is not None)
        if gradient is not None:
            gradient["class"] += states.T @ logits
            gradient["class_bias"] += logits.sum(axis=0)
            back = logits @ w["class"].T
        # Rows of one class lie side by side, so that a class is a slice of every array.
        edges = np.searchsorted(kind, np.arange(self.classes + 1)).tolist()
        inner = np.full((len(ids), self.widest), -LARGEST, np.float32)
        for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                low, high = self.borders[c : c + 2]
                np.matmul(states[a:b], w["word"][low:high].T, out=inner[a:b, : high - low])
                inner[a:b, : high - low] += w["word_bias"][low:high]
        more = _softmax(inner, ids - self.first[kind], rows, gradient is not None)
        out = np.empty(len(ids))
        out[order] = logs + more
        if gradient is None:
            return out
        for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                low, high = self.borders[c : c + 2]
                part = inner[a:b, : high - low]
                gradient["word"][low:high] += part.T @ states[a:b]
                gradient["word_bias"][low:high] += part.sum(axis=0)
                back[a:b] += part @ w["word"][low:high]
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return out, unsorted

    def gradient(self, ids: np.ndarray, keep: np.ndarray, valid: np.ndarray, state: np.ndarray) -> tuple[float, Weights]:
        """Loss a token over a window and its gradient; nothing flows back beyond the window or a document's start."""
        w, n = self.weights, self.settings.hidden
        past: list = []
        states = self.run(ids, keep, state, past)
        rows = _by_token(states)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        flat = slice(None) if valid.all() else np.flatnonzero(valid.ravel())
        logs, back = self.log_p(rows[flat], ids.ravel()[flat], grad)
        after = np.zeros((ids.size, n), np.float32)
        after[flat] = back
        after = np.ascontiguousarray(after.reshape(*ids.shape, n).transpose(0, 2, 1))
        shape = (len(ids), 3 * n, ids.shape[1])
        to_input, to_state = np.empty(shape, np.float32), np.empty(shape, np.float32)
        carried = np.zeros_like(state)
        for t in range(len(ids) - 1, -1, -1):
            z, r, new, g = past[t]
            d, e = to_input[t], to_state[t]
            d_new = np.multiply(carried * (1 - z), 1 - new * new, out=d[2 * n :])
            np.multiply(carried * (states[t] - new), z * (1 - z), out=d[:n])
            np.multiply(d_new * g, r * (1 - r), out=d[n : 2 * n])
            e[: 2 * n] = d[: 2 * n]
            np.multiply(d_new, r, out=e[2 * n :])
            carried *= z
            carried += w["state"] @ e
            carried += after[t]
            carried *= keep[t]
        grad["state"] += np.matmul(states, to_state.transpose(0, 2, 1)).sum(axis=0)
        grad["bias"] += np.matmul(to_input, np.ones(ids.shape[1], np.float32)).sum(axis=0)
        grad["input"] += np.matmul(to_input, w["embed"][ids]).sum(axis=0).T
        fed = ids.ravel().astype(np.uint16)
        order = np.argsort(fed, kind="stable")
        fed = fed[order]
        first = np.flatnonzero(np.r_[True, fed[1:] != fed[:-1]])
        grad["embed"][fed[first]] += np.add.reduceat(_by_token(np.matmul(w["input"], to_input))[order], first, axis=0)
        tokens = max(1, len(logs))
        for g in grad.values():
            g /= tokens
        return float(-logs.sum() / tokens), grad

    def train(self, documents: list[np.ndarray]) -> float:
        """One pass of Adam over the documents, end to end in lanes of one length; the mean loss a token in nats.

        A document goes on in the next lane where a lane ends, without its state."""
        s, losses = self.settings, []
        tokens = sum(map(len, documents))
        number = max(8, min(s.lanes, tokens // (s.window * s.passes)))
        steps = -(-tokens // number)
        flat, keep, valid = np.zeros(number * steps, np.int32), np.ones(number * steps, np.float32), np.zeros(number * steps, bool)
        flat[:tokens], valid[:tokens] = np.concatenate(documents), True
        keep[np.cumsum([0, *map(len, documents[:-1])])] = 0
        keep[::steps] = 0
        flat, keep, valid = (np.ascontiguousarray(x.reshape(number, steps).T) for x in (flat, keep, valid))
        state = np.zeros((s.hidden, number), np.float32)
        for t in range(0, steps, s.window):
            loss, grad = self.gradient(flat[t : t + s.window], keep[t : t + s.window], valid[t : t + s.window], state)
            self.step += 1
            losses.append(loss)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
            scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            rate = np.float32(s.rate * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
            for k, g in grad.items():
                mean, square = self.mean[k], self.square[k]
                mean *= np.float32(0.9)
                mean += g * (np.float32(0.1) * scale)
                g *= g
                g *= np.float32(0.01) * scale * scale
                square *= np.float32(0.99)
                square += g
                np.sqrt(square, out=g)
                g += np.float32(1e-6)
                np.divide(mean, g, out=g)
                g *= rate
                self.weights[k] -= g
        return float(np.mean(losses)) if losses else 0.0

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each whole document (an array of ids that ends with the end's)."""
        s = self.settings
        out = np.zeros(len(documents))
        lanes = lanes_of(documents, s.score_lanes)
        state = np.zeros((s.hidden, lanes[0].shape[1]), np.float32)
        for ids, keep, owner in windows(lanes, s.score_window, s.score_window * s.score_lanes):
            state = np.ascontiguousarray(state[:, : ids.shape[1]])
            states = self.run(ids, keep, state)
            owner = owner.ravel()
            flat = slice(None) if owner.min() >= 0 else np.flatnonzero(owner >= 0)
            logs = self.log_p(_by_token(states)[flat], ids.ravel()[flat])
            out += np.bincount(owner[flat], weights=logs, minlength=len(out))
        return out


def lanes_of(documents: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole documents end to end in lanes of nearly equal length, the longest lane first.

    Gives values, 0 where a document begins else 1, and whose value it is (-1 beyond a lane's end).
    """
    number = max(1, min(most, len(documents)))
    lanes: list[list[int]] = [[] for _ in range(number)]
    sizes = np.zeros(number, np.int64)
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        k = int(sizes.argmin())
        lanes[k].append(i)
        sizes[k] += len(documents[i])
    steps = int(sizes.max())
    values, keep = np.zeros((steps, number), np.int32), np.ones((steps, number), np.float32)
    owner = np.full((steps, number), -1, np.int32)
    for column, k in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        at = 0
        for i in lanes[k]:
            end = at + len(documents[i])
            keep[at : at + 1, column] = 0
            values[at:end, column] = documents[i]
            owner[at:end, column] = i
            at = end
    return values, keep, owner


def windows(lanes: tuple[np.ndarray, ...], size: int, cells: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of `size` steps, without the lanes that have ended; of more steps where they hold fewer than `cells`."""
    t, active = 0, (lanes[2] >= 0).sum(axis=1)
    while t < len(active):
        k = int(active[t])
        end = t + min(max(size, cells // k), 4096)
        yield tuple(x[t:end, :k] for x in lanes)
        t = end


def _pack(weights: Weights) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    return buffer.getvalue()


def _unpack(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


@dataclass
class Vocabulary:
    """The most frequent words and their counts, and the sums over all training tokens and over each group's words."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    group_tokens: np.ndarray
    group_types: np.ndarray
    settings: Settings

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        self.head = min(self.settings.head, len(self.words))
        groups = self.settings.groups
        own = np.array([group_of(w, groups) for w in self.words], np.int64)
        inside = own[: self.head]
        #: Counts of each group's words that aren't in the head; with one for each and for an unknown one: smoothed.
        self.rest = self.group_tokens - np.bincount(inside, self.counts[: self.head], groups).astype(np.int64)
        self.smoothed_rest = self.rest + self.group_types - np.bincount(inside, minlength=groups) + 1
        #: Sign of each known word.
        self.sign_of = np.r_[np.arange(self.head), self.head + own[self.head :]].astype(np.uint16)

    def head_counts(self) -> np.ndarray:
        return np.r_[self.counts[: self.head], self.rest]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The known words' places, and -1."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))

    def signs(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """The network's inputs: head words' places, the others' groups from head on."""
        out = self.sign_of[places] if self.words else np.zeros(len(places), np.uint16)
        for i in np.flatnonzero(places < 0).tolist():
            out[i] = self.head + group_of(words[i], self.settings.groups)
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs, an end for each; counted within tasks before the shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
            counts[END] += len(batch)
            if len(counts) > 300_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return docs.select("text").mapInPandas(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, settings: Settings) -> Vocabulary:
    """The driver gets two sums a group, a number for each sixteenth of a doubling of counts, and `known` words at most."""
    group_tokens, group_types = np.zeros(settings.groups, np.int64), np.zeros(settings.groups, np.int64)
    of_group = group_column(F.col("word"), settings.groups)
    for r in counts.groupBy(of_group.alias("g")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect():
        group_tokens[r["g"]], group_types[r["g"]] = r["tokens"], r["types"]
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["level"]: r["m"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()}
    lowest, room = None, settings.known
    for x in sorted(sizes, reverse=True):
        room -= sizes[x]
        if room < 0:
            break
        lowest = x
    words, numbers = [], np.zeros(0, np.int64)
    if lowest is not None:
        found = counts.where(level >= lowest).toArrow()  # no row objects on the driver
        words, numbers = found["word"].to_pylist(), found["n"].to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-numbers[i], words[i]))
    known = [words[i] for i in order]
    return Vocabulary(known, numbers[order], int(group_tokens.sum()), int(group_types.sum()), group_tokens, group_types, settings)


def encode(docs: DataFrame, vocabulary: Vocabulary, settings: Settings) -> DataFrame:
    """(row, doc_id, held_out, slice, n_tokens, n_known, base, model, rare, signs) of each row of docs.

    signs are the network's inputs, two bytes each; base and model are what the known words' counts add to either score;
    rare holds the other words, each once, and times how often each stands in the row.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = (
        "row long, doc_id long, held_out boolean, slice int, n_tokens long, n_known long, base double, model double,"
        " rare array<string>, times array<long>, signs binary"
    )

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        smoothed = np.log10(np.r_[known.counts + 1.0, 1.0])
        whole = math.log10(known.tokens + known.types + 1)
        rest = np.r_[np.zeros(known.head), np.log10(known.smoothed_rest)]
        for batch in batches:
            texts = [[*words_of(x), END] for x in batch["text"]]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            words = list(chain.from_iterable(texts))
            at = known.places(words)
            signs = known.signs(words, at)
            log = np.where(at >= 0, smoothed[at], 0.0)
            edges = np.r_[0, np.cumsum(sizes)]
            added = lambda x, edges=edges: np.add.reduceat(x, edges[:-1])
            out = batch[["row", "doc_id", "held_out", "slice"]].reset_index(drop=True)
            out["n_tokens"], out["n_known"] = sizes, added((at >= 0).astype(np.int64))
            out["base"] = added(log) - sizes * whole
            out["model"] = added(np.where(signs >= known.head, log, 0.0) - rest[signs])
            rare: list[list[bytes]] = [[] for _ in texts]
            unknown = np.flatnonzero(at < 0)
            for i, k in zip(unknown.tolist(), (np.searchsorted(edges, unknown, side="right") - 1).tolist(), strict=True):
                rare[k].append(words[i])
            met = [Counter(w for w in x if w != END) for x in rare]
            out["rare"] = [[w.decode() for w in x] for x in met]
            out["times"] = [[*x.values()] for x in met]
            raw = signs.tobytes()
            out["signs"] = [raw[2 * a : 2 * b] for a, b in pairwise(edges.tolist())]
            yield out

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (bucket_of(F.col("doc_id"), 7) == 2).alias("held_out"), "text"
    )
    slices = F.pmod(F.xxhash64("row", F.lit("train")), F.lit(settings.slices)).cast("int")
    return numbered.withColumn("slice", slices).mapInPandas(encoded, schema)


def train(encoded: DataFrame, vocabulary: Vocabulary, settings: Settings) -> Weights:
    """Weights trained on all training documents, each once: a round for each slice of them.

    A round's documents are dealt evenly to replicas, which train apart from the same weights, each on so many tokens at a
    time. The means of their weights, by tokens, are taken on executors, `fan` in a task and level by level, so that one
    set of weights reaches the driver. Rows are dealt by turns, so neither a frequent id nor nulls make a replica larger.
    """
    spark = encoded.sparkSession
    shape = spark.sparkContext.broadcast(vocabulary.head_counts())
    network = Network(vocabulary.head_counts(), settings)
    replicas = max(1, min(settings.replicas, round(vocabulary.tokens / settings.slices / settings.replica_tokens)))
    schema = "tokens long, weights binary"
    for turn in range(settings.slices):
        start = spark.sparkContext.broadcast(_pack(network.weights))

        def replica(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            own = Network(shape.value, settings, _unpack(start.value))
            held, size, tokens = [], 0, 0
            for batch in batches:
                for data in batch["signs"]:
                    held.append(np.frombuffer(data, np.uint16))
                    size += len(held[-1])
                    if size >= settings.held_tokens:
                        own.train(sorted(held, key=lambda d: zlib.crc32(d)))
                        held, size, tokens = [], 0, tokens + size
            if held:
                own.train(sorted(held, key=lambda d: zlib.crc32(d)))
            if tokens + size:
                yield pd.DataFrame({"tokens": [tokens + size], "weights": [_pack(own.weights)]})

        trained = encoded.where((F.col("slice") == turn) & ~F.col("held_out")).select("signs").repartition(replicas).mapInPandas(replica, schema)
        tasks = replicas
        while tasks > 1:
            tasks = -(-tasks // settings.fan)
            trained = trained.repartition(tasks).mapInPandas(_mean, schema)
        for r in trained.collect():  # one row, or none where the slice is empty
            network.weights = _unpack(r["weights"])
        start.unpersist()
    return network.weights


def _mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean of packed weights, by tokens."""
    total, tokens = None, 0
    for batch in batches:
        for n, data in zip(batch["tokens"], batch["weights"], strict=True):
            found = {k: v * np.float64(n) for k, v in _unpack(data).items()}
            total = found if total is None else {k: total[k] + v for k, v in found.items()}
            tokens += int(n)
    if total is not None:
        yield pd.DataFrame({"tokens": [tokens], "weights": [_pack({k: (v / tokens).astype(np.float32) for k, v in total.items()})]})


def score(encoded: DataFrame, vocabulary: Vocabulary, weights: Weights, counts: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of each row that encode() gave."""
    shipped = encoded.sparkSession.sparkContext.broadcast((vocabulary.head_counts(), _pack(weights)))
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"]

    def scored(held: list[pd.DataFrame], network: Network) -> pd.DataFrame:
        table = pd.concat(held, ignore_index=True)
        table["model"] += network.score([np.frombuffer(x, np.uint16) for x in table["signs"]]) / math.log(10)
        return table[kept]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape, packed = shipped.value
        network = Network(shape, settings, _unpack(packed))
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += int(batch["n_tokens"].sum())
            if size >= settings.gather:
                yield scored(held, network)
                held, size = [], 0
        if held:
            yield scored(held, network)

    found = encoded.select(*kept, "signs").mapInPandas(partial, encoded.select(*kept).schema)
    rare = encoded.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("row", F.col("w.rare").cast("binary").alias("word"), "w.times")
    rarer = counts.where(F.col("n") <= int(vocabulary.counts[-1])) if vocabulary.words else counts
    added = rare.join(rarer, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("met")
    )
    more = F.coalesce("more", F.lit(0.0))
    return found.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Learns from rows whose id's crc32 modulo 7 is not 2. Null and empty texts are one end. Without training rows N and V
    are 0 and every token is unknown. Repeated rows get a row each.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    learned = docs.where(bucket_of(F.col("doc_id"), 7) != 2)
    counts = scratch.write(count_words(learned))
    vocabulary = vocabulary_of(counts, settings)
    encoded = scratch.write(encode(docs, vocabulary, settings))
    found = score(encoded, vocabulary, train(encoded, vocabulary, settings), counts, settings)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
