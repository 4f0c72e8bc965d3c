"""Language identification by interpolated Kneser-Ney character models, one for each language.

Every order of n-gram lies in one sorted array of 64-bit codes for all languages, with a row of log-probabilities and
of back-off weights for each code. A text is folded (lower case, runs of other characters than letters as one space),
each of its characters is looked up at the longest known context, and the language of lowest mean cross-entropy wins.
Texts left out of the counts calibrate: a temperature turns the entropies into a probability, and for windows of each
length an entropy is set that lies beyond what their own language gives and before what the other languages give, that is,
what a language that was not learned would; a text beyond the one of the longest such window it holds is rejected.
"""

import zlib
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, small_batches, whole_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned from: whole texts of each language (the smallest hashes of ids), a quarter of which
    calibrate, and their characters together; of all languages together, so that many languages get fewer texts each, but
    eight at least."""

    texts: int = 400
    characters: int = 4_000_000
    all_texts: int = 40_000
    all_characters: int = 256_000_000
    order: int = 4
    block: int = 1 << 19
    #: Letters of the windows that the temperature is fitted on.
    window: int = 60
    #: Windows whose entropies set what is rejected: letters, doubled up to the last; windows needed; the tail's share that
    #: is measured, and the share of windows of known language that may be beyond its end; how far from there towards the
    #: lowest tenth of what other languages give the limit lies; nats beyond the tail's end where there is no other language.
    shortest: int = 8
    longest: int = 4096
    windows: int = 100
    tail: float = 0.1
    miss: float = 1e-4
    towards: float = 0.75
    slack: float = 1.0


@cache
def _fold_table() -> np.ndarray:
    """Lower-case letter of each code point; 32 for all that aren't letters."""
    table = np.full(0x110000, 32, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x32000)]:
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def fold(text: str) -> np.ndarray:
    """Code points of the folded text, with a space at both ends; just one space if it has no letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _fold_table()[raw]
    gap = codes == 32
    codes = codes[~gap | np.r_[True, ~gap[:-1]]] if len(codes) else codes
    codes = np.r_[np.uint32(32), codes, np.uint32(32)]
    if codes[1] == 32:
        codes = codes[1:]
    return codes[:-1] if len(codes) > 1 and codes[-2] == 32 else codes


_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for the n characters that end at each position from n - 1 on."""
    out = codes[n - 1 :].astype(np.uint64)
    for k in range(1, n):
        out = out * _MIX + codes[n - 1 - k : len(codes) - k]
        out ^= out >> np.uint64(29)
    return out * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Model:
    """keys[n]: sorted codes of the (n + 1)-grams; log_p[n], log_back[n]: a row for each and a column for each language,
    the n-gram's log-probability and, as a context, its back-off weight's logarithm."""

    languages: tuple[str, ...]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    log_back: list[np.ndarray]
    log_floor: np.ndarray
    temperature: float = 1.0
    #: (letters, highest entropy) by rising letters; texts of fewer letters than the first are not rejected.
    highest: tuple[tuple[int, float], ...] = ()


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the codes in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return at, keys[at] == codes


def _all_grams(texts: list[np.ndarray], order: int) -> list[tuple[np.ndarray, ...]]:
    """For n from 1: distinct n-grams, the contexts before their last letter, and what is left without
    their first, and their counts."""
    padded = [np.r_[np.full(order, 32, np.uint32), t] for t in texts]
    ends = {n: np.concatenate([grams(p, n)[order - n :] for p in padded]) for n in range(1, order + 1)}
    before = {n: np.concatenate([grams(p, n)[order - n : len(p) - n] for p in padded]) for n in range(1, order)}
    first = np.concatenate([np.arange(len(p) - order + 1) == 0 for p in padded])
    out = []
    for n in range(1, order + 1):
        own = ends[n][~first]
        codes, at, count = np.unique(own, return_index=True, return_counts=True)
        here = before[n - 1][at] if n > 1 else np.zeros(len(codes), np.uint64)
        tail = ends[n - 1][~first][at] if n > 1 else np.zeros(len(codes), np.uint64)
        out.append((codes, here, tail, count))
    return out


def train(texts: dict[str, list[np.ndarray]], settings: Settings) -> Model:
    """Counts at the highest order, numbers of left neighbours below, discounts interpolated down to a uniform share for
    unknown letters. A discount is estimated for each language and order from how many n-grams come once and twice."""
    languages, order = tuple(sorted(texts)), settings.order
    found = [_all_grams(texts[x], order) for x in languages]
    letters = len(np.unique(np.concatenate([f[0][0] for f in found])))
    keys, log_p, log_back = [], [], []
    floor = np.ones(len(languages))
    for n in range(order):
        every, at = np.unique(np.concatenate([f[n][0] for f in found]), return_index=True)
        here, tail = (np.concatenate([f[n][k] for f in found])[at] for k in (1, 2))
        table = np.zeros((len(every), len(languages)))
        if n:
            above, _ = _find(keys[n - 1], here)
            below, _ = _find(keys[n - 1], tail)
            back = np.ones((len(keys[n - 1]), len(languages)))
        for k, f in enumerate(found):
            codes, context, _, count = f[n]
            if n + 1 < order:  # how many different letters come before it
                neighbours, times = np.unique(f[n + 1][2], return_counts=True)
                place, there = _find(neighbours, codes)
                count = np.where(there, times[place], 1)
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            groups, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=count)
            mine, _ = _find(every, codes)
            table[mine, k] = (count - d) / total[inverse]
            if n:
                spot, there = _find(keys[n - 1], groups)
                back[spot[there], k] = (d * kinds / total)[there]
            else:
                floor[k] = d * len(codes) / total[0] / (letters + 1)
        if n:
            table += back[above] * np.exp(log_p[n - 1][below])
            log_back.append(np.log(back).astype(np.float32))
        else:
            table += floor
        keys.append(every)
        log_p.append(np.log(table).astype(np.float32))
    return Model(languages, keys, log_p, log_back, np.log(floor).astype(np.float32))


def log_likelihoods(model: Model, codes: np.ndarray) -> np.ndarray:
    """The log-probability of every code but the first `order`, in each language."""
    order = len(model.keys)
    ends = [grams(codes, n)[order + 1 - n :] for n in range(1, order + 1)]
    out = np.zeros((len(ends[0]), len(model.languages)), np.float32)
    left = np.arange(len(out))
    for n in range(order, 0, -1):
        at, known = _find(model.keys[n - 1], ends[n - 1][left])
        out[left[known]] += model.log_p[n - 1][at[known]]
        left = left[~known]
        if not len(left):
            return out
        if n > 1:
            context = grams(codes, n - 1)[order + 1 - n :][left]
            at, known = _find(model.keys[n - 2], context)
            out[left[known]] += model.log_back[n - 2][at[known]]
    out[left] += model.log_floor
    return out


def entropies(model: Model, texts: list[str], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean cross-entropy in nats of each whole text in each language, and its number of folded characters.

    Texts without a letter get 0 characters. Long texts and many short ones go through in blocks of bounded size.
    """
    order = len(model.keys)
    total, number = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    parts, owners, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owners, held
        if parts:
            sizes = [len(p) for p in parts]
            found = log_likelihoods(model, np.concatenate(parts))
            starts = np.cumsum([0, *sizes])
            for i, a, n in zip(owners, starts[:-1].tolist(), sizes, strict=True):
                total[i] -= found[a : a + n - order].sum(axis=0, dtype=float)
            parts, owners, held = [], [], 0

    for i, text in enumerate(texts):
        codes = fold(text)
        if len(codes) < 3:
            continue
        number[i] = len(codes)
        padded = np.r_[np.full(order, 32, np.uint32), codes]
        for a in range(0, len(codes), block):
            parts.append(padded[a : a + block + order])
            owners.append(i)
            held += len(parts[-1])
            if held >= block:
                flush()
    flush()
    return total / np.maximum(number, 1)[:, None], number


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:  # noqa: B008
    """Learns from text and lang of rows where both are known and the id's crc32 modulo 5 is not 0; None without any.

    The driver gets a count for each language, and of each some thousand ids with sizes and the texts that Settings bound;
    every language is learned, however many there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("lang", "doc_id", "text")
    rows = rows.where(bucket_of(F.col("doc_id"), 5) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    most = min(settings.texts, max(8, settings.all_texts // len(counts)))
    size = min(settings.characters, settings.all_characters // len(counts))
    texts = whole_sample(rows.select("doc_id", "text"), rows.select("lang", "doc_id"), counts, "lang", most, size)
    learn: dict[str, list[np.ndarray]] = {}
    judge: list[tuple[str, np.ndarray]] = []
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        codes = fold(r["text"])
        if len(codes) < 3:
            continue
        if zlib.crc32(f"judge {r['doc_id']}".encode()) % 4 == 0:
            judge.append((r["lang"], codes))
        else:
            learn.setdefault(r["lang"], []).append(codes)
    for lang, codes in judge:  # a language of few texts learns from them all
        if lang not in learn:
            learn[lang] = [codes]
    if not learn:
        return None
    return calibrated(train(learn, settings), [x for x in judge if x[0] in learn], settings)


def calibrated(model: Model, judge: list[tuple[str, np.ndarray]], settings: Settings) -> Model:
    """The model with a temperature and the highest entropies, from whole folded texts of known language, each cut into
    windows side by side."""
    if not judge:
        return model
    truth = np.array([model.languages.index(x) for x, _ in judge])
    losses = [_window_losses(model, codes) for _, codes in judge]
    means, owner = _window_means(losses, settings.window)
    chosen = model.temperature
    if len(means):
        right = np.arange(len(means)), truth[owner]
        chosen = min((2.0**k for k in range(8)), key=lambda heat: -np.log(_softmax(-heat * means)[right] + 1e-9).mean())
    highest, letters = [], settings.shortest
    while letters <= settings.longest:
        means, owner = _window_means(losses, letters)
        if len(means) >= settings.windows:
            highest.append((letters, _limit(means, truth[owner], settings)))
        letters *= 2
    return replace(model, temperature=chosen, highest=tuple(highest))


def _limit(means: np.ndarray, truth: np.ndarray, settings: Settings) -> float:
    """The entropy beyond which windows of one length are rejected."""
    low = np.sort(means.min(axis=1))
    tail = max(1, round(settings.tail * len(low)))
    start = float(low[-tail - 1])
    end = start + float((low[-tail:] - start).mean()) * float(np.log(settings.tail / settings.miss))
    if means.shape[1] < 2:
        return end + settings.slack
    others = means.copy()
    others[np.arange(len(others)), truth] = np.inf
    foreign = float(np.quantile(others.min(axis=1), 0.1))
    return end + settings.towards * max(foreign - end, 0.0)


def _window_losses(model: Model, codes: np.ndarray) -> np.ndarray:
    """Nats of each letter of a folded text in each language."""
    order = len(model.keys)
    return -log_likelihoods(model, np.r_[np.full(order, 32, np.uint32), codes])


def _window_means(losses: list[np.ndarray], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean losses of windows of so many letters, side by side over whole texts, and the text of each."""
    means = [x[: len(x) // letters * letters].reshape(-1, letters, x.shape[1]).mean(axis=1) for x in losses]
    return np.concatenate(means), np.repeat(np.arange(len(means)), [len(m) for m in means])


def beyond(model: Model, number: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """Whether texts of so many letters have a higher entropy than the model takes from known languages."""
    if not model.highest:
        return np.zeros(len(number), bool)
    letters, limit = (np.array(x) for x in zip(*model.highest, strict=True))
    at = np.searchsorted(letters, number, side="right") - 1
    return (at >= 0) & (entropy > limit[np.maximum(at, 0)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """docs with lang_pred, score, entropy (nats a letter) and rejected.

    Null texts and those without a letter, and all texts if nothing was learned, are `und` with score 0, rejected.
    Rejected texts in letters keep the nearest language as lang_pred. Ties go to the first language by name. Repeated rows
    are judged alike, an empty table gives no rows; other columns stay, whatever their names, but those of the result's.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def best(texts: pd.Series) -> pd.DataFrame:
        known = shipped.value
        out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "entropy": np.nan, "rejected": True}, index=texts.index)
        if known is None or not len(texts):
            return out
        mean, number = entropies(known, [x or "" for x in texts], settings.block)
        sure = _softmax(-known.temperature * mean)
        at = mean.argmin(axis=1)
        there, low = number > 0, mean.min(axis=1)
        out["lang_pred"] = np.where(there, np.array(known.languages, object)[at], UNKNOWN)
        out["score"] = np.where(there, sure[np.arange(len(at)), at], 0.0)
        out["entropy"] = np.where(there, low, np.nan)
        out["rejected"] = ~there | beyond(known, number, low)
        return out

    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "entropy", "rejected", "_best")]
    rest = [F.col(f"`{c}`") for c in rest]
    found = docs.select(*rest, best(F.col(f"`{text_col}`")).alias("_best"))
    return found.select(*rest, "_best.*")


def identify_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, lang_pred, score, entropy, rejected), a row for each row of docs; lang, source and doc_id are
    inputs of no prediction."""
    found = identify(docs.select("doc_id", "text"), fit(docs, settings), settings=settings)
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
