"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

1. Seven overlapping heuristic labellers vote "bad", "good" or nothing on each text:
   symbols, capitals, repeated words, repeated lines, table rows, exclamations, and a
   lexicon of abuse.  The lexicon starts from fixed English words; words and word beginnings that
   set toxic from clean documents apart are added from a bounded sample of labelled rows
   (``LABELLED_ROWS``), and so are beginnings of which a toxic document has ``BURST`` different
   words or more, which a few labelled documents of a language suffice to tell.
2. Votes of all documents are counted by pattern; there are at most ``3**7`` patterns,
   so the counts fit any driver.  Expectation-maximisation over the patterns estimates the
   share of bad documents and each labeller's accuracies (one table of vote
   probabilities a class), without labels.
3. The posterior of a pattern is the label of a document in a bounded training sample
   (``TRAINING_ROWS``, those whose digests are smallest, and ``TOXIC_ROWS`` labelled toxic ones,
   which are bad whatever the votes), on which a logistic scorer over
   hashed features is fitted by proximal updates that keep most weights zero.  Features:
   distinct words, their first four and five characters, and the measures in steps.
4. The scorer reads every document; ``kept`` is a score below one half.

Null and empty texts have no words: every labeller abstains and the scorer keeps them.
Null doc_ids stay null, repeated rows give equal rows, missing or empty labels leave
the fixed words.  Labels with a null id or flag are ignored, and a document with several
labels counts once for each.  Columns besides the named ones are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import batches

#: Bounds of the samples on which lexicon and scorer are fitted.
LABELLED_ROWS, TRAINING_ROWS, TOXIC_ROWS = 20_000, 15_000, 5_000
#: How often a labelled toxic row counts in training: there are few of them, and labels are surer than votes.
TOXIC_WEIGHT = 3
#: Different words with one beginning that count as a burst of it, and lengths of such beginnings.
BURST, BEGINNINGS = 3, (4, 5, 6, 7)
DIMENSIONS = 1 << 18
#: Words that a task remembers for the lexicon, and as many for the scorer; beyond that it starts anew.
KNOWN_WORDS = 800_000
#: Words of abuse to start from.
ABUSE = ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "disgusting", "worthless")
LABELLERS = ("symbols", "capitals", "repeats", "lines", "tables", "shouts", "abuse")
#: Good below the first, bad from the second on, nothing between.
CUTS = {"symbols": (0.05, 0.3), "capitals": (0.25, 0.5), "repeats": (0.05, 0.3), "lines": (0.2, 0.5), "tables": (0.02, 0.15), "shouts": (0.05, 0.3), "abuse": (1, 1)}
#: A labeller's "bad" on a good document is at most this likely; kinds of bad text rarely
#: occur together, so without the bound the model would take the rarer kinds for good.
FALSE_ALARMS = 0.001
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#*$%&|<>"
_EDGES = b".,;:!?\"'()*#$%&|<>"


def terms(word: bytes) -> list[bytes]:
    """A word without punctuation at its edges, and its beginnings of four and five characters."""
    bare = word.strip(_EDGES)
    text = bare.decode("utf-8", "ignore")
    return [bare, *[b"^" + text[:n].encode() for n in (4, 5) if len(text) >= n]] if bare else []


def beginnings(word: bytes) -> list[bytes]:
    """Beginnings of a word of which several different words may make a burst."""
    text = word.strip(_EDGES).decode("utf-8", "ignore")
    return [f"{BURST}^{text[:n]}".encode() for n in BEGINNINGS if len(text) >= n]


def bursts(words: set[bytes]) -> list[bytes]:
    """Beginnings of which a text's different words make a burst."""
    bare = {w.strip(_EDGES) for w in words}
    return [t for t, n in Counter(t for w in bare for t in beginnings(w)).items() if n >= BURST]


class Abuse(dict):
    """Word to nothing, or to whether the lexicon has one of its terms and the beginnings that it has of it."""

    def __init__(self, lexicon: frozenset[bytes]) -> None:
        self.lexicon = lexicon
        mark = f"{BURST}^"
        self.heads = {t.decode()[len(mark) :][: BEGINNINGS[0]] for t in lexicon if t.startswith(mark.encode())}

    def __missing__(self, word: bytes) -> tuple[bool, tuple[bytes, ...]] | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        hit = not self.lexicon.isdisjoint(terms(word))
        head = word.strip(_EDGES).decode("utf-8", "ignore")[: BEGINNINGS[0]]
        own = tuple(t for t in beginnings(word) if t in self.lexicon) if head in self.heads else ()
        said = self[word] = (hit, own) if hit or own else None
        return said

    def count(self, words: set[bytes]) -> int:
        """Words that the lexicon has, and beginnings that burst."""
        found = [x for x in map(self.__getitem__, words) if x is not None]
        if not found:
            return 0
        several = Counter(t for _, own in found for t in own)
        return sum(hit for hit, _ in found) + sum(n >= BURST for n in several.values())


def measure(text: str | None, abuse: Abuse) -> tuple[set[bytes], list[float]] | None:
    """Distinct lower-cased words and what the labellers look at; nothing for a text without words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return None
    raw, n, distinct = text.encode("utf-8", "surrogatepass"), len(words), set(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = max(len(raw) - raw.count(b" "), 1)
    return distinct, [
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        text.count(" | ") / n,
        text.count("!!") / n,
        float(abuse.count(distinct)),
    ]


def votes(values: list[float] | None) -> int:
    """The votes as a number in base three: 0 nothing, 1 good, 2 bad."""
    code = 0
    if values is not None:
        for name, value in zip(LABELLERS, values, strict=True):
            good, bad = CUTS[name]
            code = code * 3 + (2 if value >= bad else 1 if value < good else 0)
    return code


def fit_votes(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], float, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    Gives the posterior "bad" of each pattern, the share of bad documents, and
    ``[class, labeller, good or bad]`` probabilities.  Starts from "bad if anyone says so".
    """
    if not counts:
        return {}, 0.5, np.full((2, len(LABELLERS), 2), 0.5)
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    table = np.array([[c // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))] for c in codes])
    posterior = np.where((table == 2).any(axis=1), 0.9, 0.1)
    one_hot = np.eye(3)[table][:, :, 1:]  # pattern, labeller, good or bad; no vote says nothing
    for _ in range(rounds):
        weight = np.stack([n * (1 - posterior), n * posterior])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        said = np.einsum("cp,plv->clv", weight, one_hot) + np.array([[[0.9, 0.1]], [[0.1, 0.9]]])
        said /= said.sum(axis=2, keepdims=True)
        said[0, :, 1] = np.minimum(said[0, :, 1], FALSE_ALARMS)
        said[0, :, 0] = 1 - said[0, :, 1]
        log = np.einsum("plv,clv->cp", one_hot, np.log(said)) + np.log([[1 - share], [share]])
        following = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(following - posterior).max() < 1e-9:
            break
        posterior = following
    return dict(zip(codes, posterior.tolist(), strict=True)), share, said


def _place(name: bytes) -> int:
    return xxhash.xxh32_intdigest(name) % DIMENSIONS


def _steps(values: list[float]) -> list[bytes]:
    """The measures in steps, as names of features."""
    return [f"={name}{min(int(value * 20), 20)}".encode() for name, value in zip(LABELLERS[:-1], values, strict=False)]


class Places(dict):
    """Word to the places of its features."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= KNOWN_WORDS // 4:
            self.clear()
        found = self[word] = [_place(t) for t in terms(word)]
        return found


#: Value of the bias and the measures' features.
MEASURE_VALUE = 2.0


def damped(distinct: int) -> float:
    """Value of a word's features: long texts have more words to drown a measure in."""
    return min(1.0, 8 / max(distinct, 1) ** 0.5)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 10, batch: int = 32, rate: float = 0.3, sparse: float = 5.0) -> np.ndarray:
    """Weights of a logistic scorer by follow-the-regularised-leader with an absolute penalty; rows: feature places, their values, posterior."""
    z, n, w = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    order = np.random.default_rng(7)
    for _ in range(rounds if rows else 0):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in shuffled[at : at + batch]]
            places = np.concatenate([p for p, _, _ in part])
            values = np.concatenate([v for _, v, _ in part])
            whose = np.repeat(np.arange(len(part)), [len(p) for p, _, _ in part])
            scores = np.bincount(whose, w[places] * values, len(part))
            error = 1 / (1 + np.exp(-np.clip(scores, -30, 30))) - np.array([y for *_, y in part])
            own, back = np.unique(places, return_inverse=True)
            gradient = np.bincount(back, error[whose] * values, len(own))
            step = (np.sqrt(n[own] + gradient**2) - np.sqrt(n[own])) / rate
            z[own] += gradient - step * w[own]
            n[own] += gradient**2
            w[own] = np.where(np.abs(z[own]) <= sparse, 0, -(z[own] - np.sign(z[own]) * sparse) / ((1 + np.sqrt(n[own])) / rate))
    return w.astype(np.float32)


def _smallest(rows: DataFrame, limit: int) -> DataFrame:
    """A bounded sample of ids, the same whatever the partitions; at most ``limit`` rows, so it may be broadcast."""
    ids = rows.where("doc_id is not null").select("doc_id").distinct()
    return F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def _marked(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")


def abuse_lexicon(docs: DataFrame, labels: DataFrame, least: int = 6, least_bursts: int = 3, most_terms: int = 4000) -> frozenset[bytes]:
    """Fixed words, and terms that at least ``least`` (bursts: ``least_bursts``) toxic and nearly no clean documents of the labelled sample have."""
    marked = _marked(labels)
    sample = marked.join(_smallest(marked, LABELLED_ROWS), "doc_id").distinct()
    texts = docs.join(F.broadcast(sample.orderBy("doc_id").limit(2 * LABELLED_ROWS)), "doc_id").select("toxic", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            counts: dict[bytes, list[int]] = {}
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                words = set((text or "").lower().encode("utf-8", "surrogatepass").split())
                for t in {*(t for w in words for t in terms(w)), *bursts(words)}:
                    c = counts.setdefault(t, [0, 0])
                    c[0 if toxic else 1] += 1
            # a term without toxic documents in this piece still counts against others of its name
            yield pd.DataFrame({"term": list(counts), "toxic": [c[0] for c in counts.values()], "clean": [c[1] for c in counts.values()]})

    found = texts.mapInPandas(run, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = F.when(F.col("term").startswith(F.lit(f"{BURST}^").cast("binary")), least_bursts).otherwise(least)
    kept = found.where((F.col("toxic") >= enough) & (F.col("clean") * 100 <= F.col("toxic"))).orderBy(F.desc("toxic"), "term").limit(most_terms)
    return frozenset([bytes(r[0]) for r in kept.select("term").collect()]) | {w.encode() for w in ABUSE}


class Model:
    """Everything that scoring needs; its size is fixed by the bounds above."""

    def __init__(self, lexicon: frozenset[bytes], posterior: dict[int, float], weights: np.ndarray) -> None:
        self.lexicon, self.posterior, self.weights = lexicon, posterior, weights


class _Scores(dict):
    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = float(sum(self.weights[_place(t)] for t in terms(word)))
        return value


class Scorer:
    """A model with a task's caches."""

    def __init__(self, model: Model) -> None:
        self.model, self.abuse, self.words, self.steps = model, Abuse(model.lexicon), _Scores(model.weights), {}
        self.bias = float(model.weights[_place(b"=bias")])

    def __call__(self, text: str | None) -> tuple[float, float]:
        """Posterior of the votes and score, both of "bad"."""
        seen = measure(text, self.abuse)
        if seen is None:
            return self.model.posterior.get(0, 0.0), 0.0
        distinct, values = seen
        total = MEASURE_VALUE * (self.bias + sum(float(self.model.weights[_place(s)]) for s in _steps(values))) + damped(len(distinct)) * sum(map(self.words.__getitem__, distinct))
        return self.model.posterior.get(votes(values), 0.5), float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, vote model and scorer."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = abuse_lexicon(texts, labels)

    def patterns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        abuse, seen = Abuse(lexicon), {}
        for frame in batches(frames):
            for text in frame["text"]:
                found = measure(text, abuse)
                code = votes(found and found[1])
                seen[code] = seen.get(code, 0) + 1
        yield pd.DataFrame({"code": pd.Series(list(seen), dtype="int64"), "n": pd.Series(list(seen.values()), dtype="int64")})

    counted = texts.select("text").mapInPandas(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    posterior, _, _ = fit_votes({r["code"]: r["n"] for r in counted.collect() if r["code"]})

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        abuse, places = Abuse(lexicon), Places()
        for frame in batches(frames):
            out = []
            for doc, text, toxic in zip(frame["doc_id"], frame["text"], frame["toxic"], strict=True):
                found = measure(text, abuse)
                if found is not None:
                    ids = [_place(b"=bias"), *map(_place, _steps(found[1]))]
                    values = [MEASURE_VALUE] * len(ids)
                    ids += [i for w in sorted(found[0]) for i in places[w]]
                    values += [damped(len(found[0]))] * (len(ids) - len(values))
                    row = (doc, np.array(ids, np.int32), np.array(values, np.float32), 1.0 if toxic else posterior.get(votes(found[1]), 0.5))
                    out += [row] * (TOXIC_WEIGHT if toxic else 1)
            yield pd.DataFrame(out, columns=["doc_id", "places", "v", "y"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(doc, np.asarray(p, np.int32), np.asarray(v, np.float32), y) for frame in frames for doc, p, v, y in zip(frame["doc_id"], frame["places"], frame["v"], frame["y"], strict=True)]
        rows.sort(key=lambda r: r[0])
        yield pd.DataFrame({"weights": [train([r[1:] for r in rows]).tobytes()]})

    some = _smallest(texts, TRAINING_ROWS).withColumn("toxic", F.lit(False))
    worst = _smallest(_marked(labels).where("toxic = 1"), TOXIC_ROWS).withColumn("toxic", F.lit(True))
    ids = some.unionByName(worst).groupBy("doc_id").agg(F.bool_or("toxic").alias("toxic"))  # at most both samples
    chosen = texts.join(F.broadcast(ids), "doc_id").mapInPandas(features, "doc_id long, places array<int>, v array<float>, y double")
    learned = chosen.repartition(1).mapInPandas(learn, "weights binary").first()
    return Model(lexicon, posterior, np.frombuffer(learned[0], np.float32) if learned else np.zeros(DIMENSIONS, np.float32))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, posterior, score, kept)`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for frame in batches(frames):
            found = [scorer(x) for x in frame["text"]]
            score = np.array([f[1] for f in found])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "posterior": [f[0] for f in found], "score": score, "kept": score < 0.5})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for piece in pieces:
            texts = piece.column(piece.schema.get_field_index("text"))
            yield piece.filter(pa.array([scorer(t.as_py())[1] < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
