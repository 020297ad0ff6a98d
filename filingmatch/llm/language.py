"""Language identification with word-first backoff.

Every known word of a text adds its log frequency in each language. An unseen word is read as character n-grams: at each place
the longest known n-gram of at most four characters counts, then three, two and one, and the word adds their mean. The language with
the highest sum wins; the score is its softmax share.

Frequencies are counted over all training rows. Runs of letters are cut and counted by Arrow, batch by batch; Spark sums the counts of the
distinct runs, and only those become small-letter words and n-grams. Units (words, or n-grams of one length) with less than `min_share` of
their language's count are left out of the model, which bounds it, and so the broadcast, to 1 / min_share units for each language and length
(50,000 by default); a left-out unit counts as half the bound. With a `min_share` of 0 the model holds every unit. A prediction cuts its texts
the same way, scores each distinct run of a batch once and adds up by document; nothing but the text is read for it.

A null text, or one without a letter, is `und` with score 0, as is every text when nothing was learned. Texts of any length
are read whole. A null doc_id is neither held out nor learned from. Repeated rows count as often as they occur and come out
repeated; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import arrow_map, held

SIZES = (4, 3, 2, 1)
MIN_SHARE = 2e-5
#: Distinct runs that a counting task holds, and runs whose scores a worker remembers.
PIECES = 100_000
CACHED = 100_000
#: Bytes of text that are cut into runs at once.
TOGETHER = 2 << 20
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_BETWEEN = r"[^\p{L}]+"


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def words(run: str) -> list[str]:
    """The words of a run of letters, in small letters (a letter may become several, marks among them)."""
    low = run.lower()
    return [low] if low.isalpha() else _LETTERS.findall(low)


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The runs of letters of some texts: for each its text's place and its number in the list of distinct runs. Empty runs, at the ends of
    a text, are among them."""
    cut = pc.split_pattern_regex(texts, _BETWEEN)
    coded = cut.flatten().dictionary_encode()
    return pc.list_parent_indices(cut).to_numpy(), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about `TOGETHER` bytes of text, so that what is made of their runs stays small; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield at, to
        at = to


def _count_runs(batches: Iterator[dict]) -> Iterator[dict]:
    """(lang, run, n). What was counted is sent on whenever many different runs are held."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> dict:
        out = {"lang": [], "run": [], "n": []}
        for lang, c in counts.items():
            out["lang"] += [lang] * len(c)
            out["run"] += c.keys()
            out["n"] += c.values()
        counts.clear()
        return out

    for b in batches:
        langs = b["lang"].dictionary_encode()
        numbers, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for lo, hi in stretches(b["text"]):
            of, code, distinct = runs(b["text"].slice(lo, hi - lo))
            keys, n = np.unique(numbers[lo:hi][of].astype(np.int64) * max(1, len(distinct)) + code, return_counts=True)
            for key, times in zip(keys.tolist(), n.tolist(), strict=True):
                at, run = divmod(key, len(distinct))
                if distinct[run]:
                    counts[names[at]][distinct[run]] += times
            if sum(map(len, counts.values())) > PIECES:
                yield flush()
    yield flush()


def _count_units(batches: Iterator[dict]) -> Iterator[dict]:
    """(lang, size, unit, n) of counted runs: words have size 0. What was counted is sent on whenever many units are held."""
    counts: dict[str, list[Counter]] = defaultdict(lambda: [Counter() for _ in range(1 + len(SIZES))])

    def flush() -> dict:
        out = {"lang": [], "size": [], "unit": [], "n": []}
        for lang, sized in counts.items():
            for size, c in zip((0, *SIZES), sized, strict=True):
                out["lang"] += [lang] * len(c)
                out["size"] += [size] * len(c)
                out["unit"] += c.keys()
                out["n"] += c.values()
        counts.clear()
        return out

    for b in batches:
        for lang, run, n in zip(b["lang"].to_pylist(), b["run"].to_pylist(), b["n"].to_pylist(), strict=True):
            known, *sized = counts[lang]
            for word in words(run):
                known[word] += n
                w = f"_{word}_"
                for size, c in zip(SIZES, sized):
                    for i in range(len(w) - size + 1):
                        c[w[i:i + size]] += n
        if sum(len(c) for sized in counts.values() for c in sized) > PIECES:
            yield flush()
    yield flush()


class Model:
    """Log frequencies by unit: `words[w]` and `grams[g]` are rows of `logs`, one column per language."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, dict[str, float]]], floor: float):
        self.langs = langs
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.logs = np.full((len(rows), len(langs)), math.log(floor))
        for i, (size, unit, share) in enumerate(rows):
            (self.grams if size else self.words)[unit] = i
            for lang, x in share.items():
                self.logs[i, langs.index(lang)] = math.log(x)
        self._start()

    def _start(self) -> None:
        self.place: dict[str, int] = {}                                 # run to row of `sums`
        self.sums = np.zeros((CACHED, len(self.langs) + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "sums")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def units(self, word: str) -> list[int]:
        """The row of a known word, else the rows of the longest known n-gram at each of its places."""
        at = self.words.get(word)
        if at is not None:
            return [at]
        get, w, found, longest, shorter = self.grams.get, f"_{word}_", [], SIZES[0], SIZES[1:]
        for i in range(len(w)):
            at = get(w[i:i + longest])
            if at is None:
                for size in shorter:
                    at = get(w[i:i + size])
                    if at is not None:
                        break
                else:
                    continue
            found.append(at)
        return found

    def score(self, some: list[str]) -> np.ndarray:
        """Sums of runs, one row each, the last column being their number of words."""
        rows, owner, size, n_words = [], [], [], []
        for k, run in enumerate(some):
            known = words(run) if run else []
            n_words.append(len(known))
            for w in known:
                found = self.units(w)
                rows += found
                owner.append(k)
                size.append(len(found))
        out = np.zeros((len(some), len(self.langs) + 1))
        out[:, -1] = n_words
        if rows:
            n = np.array(size)
            owners, shares = np.repeat(owner, n), np.repeat(1 / np.maximum(n, 1), n)
            for j in range(len(self.langs)):
                out[:, j] = np.bincount(owners, weights=self.logs[rows, j] * shares, minlength=len(some))
        return out

    def scores(self, distinct: list[str]) -> np.ndarray:
        """`score` of distinct runs; those not seen lately are scored together, and the memory of runs starts anew when full."""
        place = self.place
        new = [r for r in distinct if r not in place]
        if len(place) + len(new) > CACHED:
            place.clear()
            new = distinct
            if len(new) > CACHED:
                return self.score(new)
        self.sums[len(place):len(place) + len(new)] = self.score(new)
        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        return self.sums[[place[r] for r in distinct]]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        out, share = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for lo, hi in stretches(texts) if self.langs else ():
            of, code, distinct = runs(texts.slice(lo, hi - lo))
            sums = self.scores(distinct)
            totals = np.stack([np.bincount(of, weights=sums[code, j], minlength=hi - lo) for j in range(sums.shape[1])], axis=1)
            logs = totals[:, :-1] - totals[:, :-1].max(axis=1, keepdims=True)
            shares = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
            best = shares.argmax(axis=1)
            for k in np.flatnonzero(totals[:, -1]).tolist():
                out[lo + k], share[lo + k] = self.langs[best[k]], float(shares[k, best[k]])
        return out, share


def train(labelled: DataFrame, min_share: float = MIN_SHARE) -> Model:
    """The model of `labelled` (lang, text; rows with a null in either are passed over)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counted, _ = stored(arrow_map(rows, _count_runs, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "runs")
    counts, _ = stored(arrow_map(counted, _count_units, "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")), "units")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, ["lang", "size"]).where(F.col("n") >= min_share * F.col("total")).select("size", "unit", "lang", (F.col("n") / F.col("total")).alias("share"))
    by_unit: dict[tuple[int, str], dict[str, float]] = defaultdict(dict)
    for r in kept.toLocalIterator():
        by_unit[r.size, r.unit][r.lang] = r.share
    floor = (min_share or min((x for share in by_unit.values() for x in share.values()), default=1.0)) / 2
    return Model(sorted({lang for share in by_unit.values() for lang in share}), [(s, u, x) for (s, u), x in sorted(by_unit.items())], floor)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            langs, scores = held(shared).predict(b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": langs, "score": scores}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text, lang), learned from the rows that are not held
    out."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"), min_share)
    return predicted(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep_readable(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """`docs` without the rows whose language cannot be told: `und`, or a score below `min_score`. All columns kept."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def readable(text):
        import pandas as pd
        langs, scores = held(shared).predict(pa.array(text, pa.string(), from_pandas=True))
        return pd.Series([x != UNKNOWN and s >= min_score for x, s in zip(langs, scores, strict=True)], dtype=bool)

    return docs.where(readable("text"))
