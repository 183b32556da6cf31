"""Toxicity by weak supervision.

Voters: single words and word stems (a public English list, and those that the labelled training rows single out), groups of
rarer stems, and patterns.  A voter fires on a text or abstains.  A generative label model estimates by expectation-maximisation how often each
voter fires on toxic and on clean texts, and how voters correlate within a class; a cluster of correlated voters counts as little more than
one of them.  Its posteriors label the texts from which a logistic regression over voter counts and text shape is trained; its
logit, scaled to the labelled training rows, gives the score.

Bounds: stems are mined from at most ``MINE_ROWS`` labelled rows, all that pass the thresholds, and the regression is trained on at most ``TRAIN_ROWS`` rows with
posteriors, and scaled on at most as many labelled ones; the label model's sums cover all training rows.

Samples are the rows of the least hashed ids, so they do not depend on how Spark dealt the rows.

Defined cases: null and empty texts fire no voter and get the regression's score for such a text; labels that are null, or whose doc_id is no document, train nothing;
of several labels for one document the highest counts (in mining, each); without labels the public list alone votes; equal texts get equal scores; an empty table gives an empty table;
other columns pass through ``score_texts`` and ``without_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueframe.llm.common import free_name, materialize, release

# Common English insults.
LEXICON = (
    "airhead", "bastard", "bitch", "brainless", "buffoon", "clown", "coward", "cretin", "crap", "degenerate", "despicable", "disgusting",
    "dumb", "dumbass", "fool", "freak", "garbage", "hideous", "idiot", "idiotic", "imbecile", "jackass", "jerk", "liar", "loser", "lunatic", "maggot",
    "moron", "moronic", "nasty", "parasite", "pathetic", "pig", "repulsive", "retard", "rubbish", "scum", "scumbag", "shit", "sleazy", "stupid", "swine",
    "trash", "ugly", "useless", "vermin", "vile", "wimp", "worthless",
)

MINE_ROWS, TRAIN_ROWS = 16_000, 16_000
#: A mined stem occurs in so many toxic training texts at least, and this share of the labelled texts that have it is toxic: at least the
#: second; stems under the first are taken only where no purer one begins the word.
MIN_SUPPORT, PURE, MIN_PRECISION = 8, 0.9, 0.6
#: So many stems at most are expected to pass by chance, of all that are tested: a large table has so many rare words that thousands of them fall into
#: toxic texts alone.
MAX_CHANCE = 0.05
#: A stem says nothing new in a text that has a pure one so many times as frequent.
LEAD = 4
STEM_SIZES = (4, 5, 6, 7)
SINGLE_VOTERS, GROUP_VOTERS = 44, 8
EM_ROUNDS = 8
_SHOUT, _NOISE = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"[&%$#*@]{3}")
_ADDRESS = re.compile(r"\b(?:you|your|du|tu|vous|usted)\b", re.I)
PATTERNS = ("shouting", "noise", "address")
SHAPE = 4


@dataclass
class Voters:
    """Stem i casts the vote of voter ``owner[i]``; a stem with a final blank is a whole word, the others begin a word.  The last voters are PATTERNS."""

    stems: list[str]
    owner: list[int]
    names: list[str]

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for stem, owner in zip(self.stems, self.owner, strict=True):
            word = stem.rstrip()
            machine.add_word(word, (len(word), stem != word, owner))
        if self.stems:
            machine.make_automaton()
        return machine


def counts(voters: Voters, machine, text: str | None) -> np.ndarray:
    """How often each voter fires on the text, then the text's shape."""
    text = text or ""
    out = np.zeros(len(voters.names) + SHAPE)
    low = text.lower()
    n = len(low)
    if voters.stems:
        for end, (size, whole, owner) in machine.iter(low):
            first = end - size
            if (first < 0 or not low[first].isalpha()) and not (whole and end + 1 < n and low[end + 1].isalpha()):
                out[owner] += 1
    v = len(voters.names)
    shout, noise = len(_SHOUT.findall(text)), len(_NOISE.findall(text))
    words = text.count(" ") + text.count("\n") + 1
    out[v - 3] = shout > 0.3 * words
    out[v - 2] = noise > 0.3 * words
    out[v - 1] = bool(_ADDRESS.search(text))
    hits = out[: v - 3].sum()
    out[v:] = hits > 0, math.log1p(hits), 100 * hits / (words + 20), math.log1p(n) / 10
    return out


def chance(hits: int, n: int, toxic: int, total: int) -> float:
    """At most how likely it is that of ``n`` texts, drawn blindly from ``total`` with ``toxic`` toxic ones, ``hits`` or more are toxic (1 where that is expected)."""
    if hits * total <= n * toxic:
        return 1.0
    ways = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    first = math.exp(min(0.0, ways(toxic, hits) + ways(total - toxic, n - hits) - ways(total, n)))
    # Beyond the mean each further term of the hypergeometric tail shrinks by this factor or more.
    factor = (toxic - hits) * (n - hits) / ((hits + 1) * (total - toxic - n + hits + 1))
    return min(1.0, first / (1 - factor)) if factor < 1 else 1.0


def _beginnings(words, size: int):
    """The first ``size`` letters of the words that have as many.  The size must not be a second parameter of the lambdas: Spark would pass a word's place."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.substring(w, 1, size))


def _unexplained(rows: DataFrame, best: list) -> list:
    """Those of ``best`` that MIN_SUPPORT toxic texts have without a pure stem that is LEAD times as frequent.  ``rows``: each text's stems.

    All words of near copies of one toxic text fall into toxic texts alone; what makes that text toxic does so in many others too.
    """
    if not best:
        return best
    spark = rows.sparkSession
    side = spark.createDataFrame([(r.stem, int(r.hits), r.precision >= PURE) for r in best], "stem string, hits long, pure boolean")
    held = rows.where("toxic = 1").join(F.broadcast(side), "stem").groupBy("doc_id")
    held = held.agg(F.max(F.when(F.col("pure"), F.col("hits"))).alias("most"), F.collect_set(F.struct("stem", "hits")).alias("held"))
    alone = held.select("most", F.inline("held")).where(F.coalesce(F.col("most"), F.lit(0)) < LEAD * F.col("hits")).groupBy("stem").count()
    # As many rows as ``best`` at most.
    alone = {r.stem for r in alone.where(F.col("count") >= MIN_SUPPORT).select("stem").collect()}
    return [r for r in best if r.stem in alone]


def mine(docs: DataFrame, labels: DataFrame, mine_rows: int = MINE_ROWS) -> list[tuple[str, int, bool]]:
    """(stem or word, toxic texts that have it, whether it is pure) of the stems that single toxic texts out."""
    return _mined(docs, labels, mine_rows)[0]


def _mined(docs: DataFrame, labels: DataFrame, mine_rows: int) -> tuple[list[tuple[str, int, bool]], set[str]]:
    """What ``mine`` returns, and the words of the list that MIN_SUPPORT texts have, most of them clean: they are plain words in some language."""
    size = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {toxic: min(1.0, mine_rows / 2 / n) for toxic, n in size.items()}
    share = F.lit(0.0)
    for toxic, p in part.items():
        share = F.when(F.col("toxic") == toxic, p).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(mine_rows)
    # At most mine_rows ids and labels, so the texts need no shuffle.
    sample = docs.join(F.broadcast(chosen), "doc_id")
    toxic_rows, all_rows = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = F.concat(F.transform(words, lambda w: F.concat(w, F.lit(" "))), *[_beginnings(words, k) for k in STEM_SIZES])
    rows = sample.select("doc_id", "toxic", F.explode(F.array_distinct(stems)).alias("stem")).where(F.length("stem") > 3)
    found = rows.groupBy("stem").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SUPPORT)
    # A label is sampled by its own share; precision is that among all labelled texts.
    toxic_mass, clean_mass = F.col("hits") / part.get(1, 1.0), (F.col("n") - F.col("hits")) / part.get(0, 1.0)
    found = materialize(found.withColumn("precision", toxic_mass / (toxic_mass + clean_mass)), "stems")
    tested = found.count()
    listed = found.where(F.col("stem").isin([f"{w} " for w in LEXICON]) & (F.col("precision") < MIN_PRECISION))
    refuted = {r.stem.rstrip() for r in listed.select("stem").collect()}
    # Every stem over the thresholds; mine_rows bounds them.
    best = found.where((F.col("hits") >= MIN_SUPPORT) & (F.col("precision") >= MIN_PRECISION)).collect()
    best = [r for r in best if tested * chance(r.hits, r.n, toxic_rows, all_rows) <= MAX_CHANCE]
    best = _unexplained(rows, best)
    out: list[tuple[str, int, bool]] = []
    # The shortest stems first: what begins with a chosen stem adds nothing to it.
    chosen: set[str] = set()
    taken: set[str] = set()
    pure = {r.stem: r.precision >= PURE for r in best}
    for r in sorted(best, key=lambda r: (not pure[r.stem], len(r.stem.rstrip()), r.stem)):
        word = r.stem.rstrip()
        if word not in taken and not any(word[:k] in chosen for k in range(3, len(word) + 1)):
            out.append((r.stem, int(r.hits), pure[r.stem]))
            taken.add(word)
            if word == r.stem:
                chosen.add(word)
    return sorted(out, key=lambda x: (-x[1], x[0])), refuted


def voters_from(mined: list[tuple[str, int, bool]], refuted: Iterable[str] = ()) -> Voters:
    """The most frequent mined stems each have a voter; the rest, and the list's other words but the refuted ones, share group voters, pure ones and others apart."""
    known = [s.rstrip() for s, _, _ in mined]
    rest = [(f"{w} ", 0, True) for w in LEXICON if w not in refuted and not any(w.startswith(s) for s in known)]
    stems = mined + rest
    single = min(SINGLE_VOTERS, len(mined))
    groups = GROUP_VOTERS // 2
    owner = [i if i < single else single + i % groups + (0 if pure else groups) for i, (_, _, pure) in enumerate(stems)]
    names = [s for s, _, _ in stems[:single]] + [f"group {g}" for g in range(2 * groups)] + list(PATTERNS)
    return Voters([s for s, _, _ in stems], owner, names)


@dataclass
class LabelModel:
    """P(fires | toxic), P(fires | clean), P(toxic), and each voter's weight, 1 over the size of what it repeats."""

    toxic: np.ndarray
    clean: np.ndarray
    prior: float
    weight: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        with_, without = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        logit = math.log(self.prior / (1 - self.prior)) + (fired * (with_ - without) + without) @ self.weight
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _votes(voters: Voters, batch: pa.RecordBatch, column: int, machine) -> np.ndarray:
    return np.stack([counts(voters, machine, t) for t in batch.column(column).to_pylist()]) if batch.num_rows else np.zeros((0, len(voters.names) + SHAPE))


def _vote_batches(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = voters.matcher()
        for batch in batches:
            x = _votes(voters, batch, 1, machine)
            fired = np.packbits(x[:, : len(voters.names)] > 0, axis=1) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f in fired], pa.binary()), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["doc_id", "fired", "x"]
            )
        release()

    return run


def _em_sums(model: LabelModel, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, v + 1))
        pair = np.zeros((2, v, v))
        for batch in batches:
            if batch.num_rows:
                fired = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)[:, :v].astype(float)
                n, known = np.asarray(batch.column(1)).astype(float), np.asarray(batch.column(2))
                p = np.where(known < 0, model.posterior(fired), known)
                for k, mass in enumerate((n * p, n * (1 - p))):
                    total[k, 0] += mass.sum()
                    total[k, 1:] += mass @ fired
                    pair[k] += (fired * mass[:, None]).T @ fired
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), pair.ravel()]).tobytes()], pa.binary())], ["s"])

    return run


def fit_label_model(patterns: DataFrame, v: int, start: LabelModel, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over ``fired, n, known``: vote patterns, how many texts show them, and those texts' label (-1: none), which stands where
    there is one.  Each round sums on the executors."""
    model = start
    labelled = {r.known: r.n for r in patterns.where("known >= 0").groupBy("known").agg(F.sum("n").alias("n")).collect()}
    first = patterns.where("known >= 0") if min(labelled.get(0, 0), labelled.get(1, 0)) >= MIN_SUPPORT else patterns
    for k in range(rounds + 1):
        # The guess ``start`` may call all unlabelled texts of a rare language clean, and later rounds keep to that: where there are labels, they begin.
        sums = sum((np.frombuffer(r.s) for r in (patterns if k else first).mapInArrow(_em_sums(model, v), "s binary").collect()), np.zeros(2 * (v + 1) + 2 * v * v))
        total, pair = sums[: 2 * (v + 1)].reshape(2, v + 1), sums[2 * (v + 1) :].reshape(2, v, v)
        n = total.sum(axis=0)[0]
        rate = (total[:, 1:] + 0.1) / (total[:, :1] + 1.0)
        # Within a class: correlation of each two voters; a voter shares its weight with those it repeats.
        cov = pair / np.maximum(total[:, 0], 1.0)[:, None, None] - rate[:, :, None] * rate[:, None, :]
        spread = np.sqrt(np.clip(rate * (1 - rate), 1e-9, None))
        corr = (np.abs(cov / (spread[:, :, None] * spread[:, None, :])) * (pair >= 5)).max(axis=0)
        np.fill_diagonal(corr, 1.0)
        weight = 1 / np.where(corr > 0.5, corr, 0.0).sum(axis=1)
        prior = float(np.clip(total[0, 0] / max(n, 1.0), 0.001, 0.5))
        # Lexicon voters speak for toxicity only; patterns may lean either way.
        toxic, clean = np.clip(rate[0], 1e-4, 1 - 1e-4), np.clip(rate[1], 1e-6, 1 - 1e-4)
        toxic[: v - len(PATTERNS)] = np.maximum(toxic[: v - len(PATTERNS)], clean[: v - len(PATTERNS)])
        if n == 0 or k == rounds:
            break
        model = LabelModel(toxic, clean, prior, weight)
    return model


@dataclass
class Classifier:
    voters: Voters
    coef: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(x) @ self.coef + self.bias, -30, 30)))


def _features(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, : x.shape[1] - SHAPE] = np.minimum(x[:, : x.shape[1] - SHAPE], 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Newton's method with soft labels."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def vote(docs: DataFrame, voters: Voters) -> DataFrame:
    """``doc_id, fired, x``: each row's voters and counts, written once."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(docs.mapInArrow(_vote_batches(voters), "doc_id long, fired binary, x binary"), "votes")


def find_voters(docs: DataFrame, labels: DataFrame, mine_rows: int = MINE_ROWS) -> Voters:
    """Voters for ``docs``, from ``labels``: ``doc_id, toxic`` of rows that may be learned from."""
    return voters_from(*_mined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _labels(labels), mine_rows))


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))


def fit(docs: DataFrame, labels: DataFrame, mine_rows: int = MINE_ROWS, train_rows: int = TRAIN_ROWS) -> Classifier:
    """``docs``: ``doc_id, text`` of the training rows; ``labels``: ``doc_id, toxic`` of rows that may be learned from."""
    voters = find_voters(docs, labels, mine_rows)
    return fit_votes(voters, vote(docs, voters), labels, train_rows)


def fit_votes(voters: Voters, votes: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Learns from the ``votes`` of the training rows."""
    v = len(voters.names)
    known = _labels(labels).groupBy("doc_id").agg(F.max("toxic").alias("known"))
    patterns = votes.select("doc_id", "fired").join(known, "doc_id", "left").groupBy("fired", F.coalesce("known", F.lit(-1)).alias("known"))
    patterns = materialize(patterns.agg(F.count(F.lit(1)).alias("n")).select("fired", "n", "known"), "patterns")
    flat = np.full(v, 0.05)
    flat[v - len(PATTERNS) :] = 0.1
    rare = np.full(v, 0.001)
    rare[v - len(PATTERNS) :] = 0.1
    model = fit_label_model(patterns, v, LabelModel(flat, rare, 0.1, np.ones(v)))
    total = votes.count()
    chosen = _sample(votes, total, train_rows).join(known, "doc_id", "left").select("doc_id", "x", "known").orderBy(F.xxhash64("doc_id"), "x", "known").collect()
    if not chosen:
        return Classifier(voters, np.zeros(v + SHAPE), -3.0)
    x = np.frombuffer(b"".join(bytes(r.x) for r in chosen), "<f4").reshape(-1, v + SHAPE).astype(float)
    label = np.array([-1 if r.known is None else r.known for r in chosen])
    coef, bias = _logistic(_features(x), np.where(label < 0, model.posterior((x[:, :v] > 0).astype(float)), label))
    return _scaled(Classifier(voters, coef, bias), _sample(votes.join(_sample(known, known.count(), train_rows), "doc_id"), 1, train_rows))


def _sample(rows: DataFrame, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows, those of the least hashed ids, and no more."""
    share = min(1.0, most / max(total, 1))
    key = F.xxhash64("doc_id")
    return rows.where(F.pmod(key, F.lit(1 << 20)) < F.lit(share * (1 << 20))).orderBy(key, *rows.columns).limit(most)


def _scaled(model: Classifier, labelled: DataFrame) -> Classifier:
    """The classifier with its logit scaled and moved so that labelled rows get true probabilities; as it is where a label has under MIN_SUPPORT rows."""
    rows = labelled.select("x", "known").collect()
    y = np.array([r.known for r in rows], float)
    if min((y == 1).sum(), (y == 0).sum()) < MIN_SUPPORT:
        return model
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), "<f4").reshape(len(rows), -1).astype(float)
    slope, move = _logistic((_features(x) @ model.coef + model.bias)[:, None], y)
    return Classifier(model.voters, model.coef * slope[0], model.bias * slope[0] + move) if slope[0] > 0 else model


def _score_batches(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.voters.matcher()
        for batch in batches:
            score = model.score(_votes(model.voters, batch, 0, machine)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])
        release()

    return run


def score_texts(docs: DataFrame, model: Classifier, name: str = "c_score") -> DataFrame:
    """``docs`` with a score column behind its own, of that name or, where ``docs`` has one, of the next free one."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(docs.columns, inner, strict=True)])
    fields = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(inner, docs.schema, strict=True))
    return rows.mapInArrow(_score_batches(model), f"{fields}score double").toDF(*docs.columns, free_name(name, docs.columns))


def _score_vote_batches(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.voters.names) + SHAPE
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, width).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score_votes(votes: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, score`` from votes that are there already."""
    return votes.select("doc_id", "x").mapInArrow(_score_vote_batches(model), "doc_id long, score double")


def _clean_batches(model: Classifier, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.voters.matcher()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(_votes(model.voters, batch, column, machine)) < threshold))
        release()

    return run


def without_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``; ``docs``'s own columns."""
    return docs.mapInArrow(_clean_batches(model, docs.columns.index("text"), threshold), docs.schema)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    voters = find_voters(docs.where(~held_out()), labels)
    # One pass over the texts: the votes of all rows, of which the training rows' are learned from and all are scored.
    votes = vote(docs, voters)
    out = score_votes(votes, fit_votes(voters, votes.where(~held_out()), labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
