"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Training is backpropagation through time over crops of a bounded sample of labelled documents. A document's bytes are
cut into segments that run side by side; every byte position gets a distribution over the languages from the states of
both directions, and a document's probabilities are their mean over all of its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import sheltered, small_batches, table, tidy

#: Documents of each language in the training sample, crops of each, bytes of a crop.
SAMPLE_DOCS, CROPS, CROP = 400, 4, 96
#: Languages of the training sample; rarer ones are not learned.
MAX_LANGS = 500
#: Parts in which a language's documents are ranked first.
SALTS = 64
#: States of each direction; training steps, rows of a step, rate.
STATES, STEPS, ROWS, RATE = 8, 400, 96, 0.02
#: Bytes of a segment when documents are labelled, and segments that run side by side.
SEGMENT, LANES = 128, 2048
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteTagger:
    """Weights: for each direction a table of byte inputs [256, 3H] and a state matrix [H, 3H]; an output layer."""

    def __init__(self, langs: list[str], states: int = STATES, seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs, self.h = langs, states
        self.w = {}
        for d in "fb":
            self.w["x" + d] = r.normal(0, 0.3, (256, 3 * states))
            self.w["u" + d] = r.normal(0, states**-0.5, (states, 3 * states))
            self.w["o" + d] = r.normal(0, 0.3, (states, len(langs)))
        self.w["o"] = np.zeros(len(langs))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def step(self, x: np.ndarray, h: np.ndarray, d: str):
        """x: inputs [n, 3H]. Gates: update z, reset r, candidate c."""
        k = self.h
        u = h @ self.w["u" + d]
        zr = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
        return c + z * (h - c), z, r, c, u[:, 2 * k :]

    def loss_gradients(self, data: np.ndarray, labels: np.ndarray):
        """data: bytes [n, T]; labels [n]. Every position is to say its row's label."""
        n, steps = data.shape
        k, w = self.h, self.w
        states, kept = {}, {}
        for d in "fb":
            h = np.zeros((n, k), np.float32)
            states[d], kept[d] = [None] * steps, [None] * steps
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                before = h
                h, z, r, c, u = self.step(w["x" + d][data[:, t]], h, d)
                states[d][t], kept[d][t] = h, (before, z, r, c, u)
        hf, hb = np.stack(states["f"]), np.stack(states["b"])  # [T, n, H]
        logits = hf @ w["of"] + hb @ w["ob"] + w["o"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        loss = -np.log(p[:, np.arange(n), labels] + 1e-9).mean()
        p[:, np.arange(n), labels] -= 1
        p /= n * steps
        g = {"o": p.sum((0, 1)), "of": np.einsum("tnh,tnc->hc", hf, p), "ob": np.einsum("tnh,tnc->hc", hb, p)}
        for d in "fb":
            gx, gu = np.zeros_like(w["x" + d]), np.zeros_like(w["u" + d])
            back = np.zeros((n, k), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                before, z, r, c, u = kept[d][t]
                gh = back + p[t] @ w["o" + d].T
                gc = gh * (1 - z) * (1 - c * c)
                gz = gh * (before - c) * z * (1 - z)
                gr = gc * u * r * (1 - r)
                into = np.concatenate([gz, gr, gc * r], 1)  # by the state's product
                gu += before.T @ into
                np.add.at(gx, data[:, t], np.concatenate([gz, gr, gc], 1))
                back = gh * z + into @ w["u" + d].T
            g["x" + d], g["u" + d] = gx, gu
        return loss, g

    def fit(self, data: np.ndarray, labels: np.ndarray, steps: int = STEPS, rows: int = ROWS, rate: float = RATE, seed: int = 7):
        """Adam over rows drawn evenly from the languages."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = np.array([r.choice(by[j % len(by)]) for j in range(rows)])
            _, g = self.loss_gradients(data[pick], labels[pick])
            now = rate * min(1, 2 * (1 - (i - 1) / steps))
            for k, x in self.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                x -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def positions(self, data: np.ndarray) -> np.ndarray:
        """The distribution at each position of data [n, T]: [T, n, languages]."""
        n, steps = data.shape
        w = self.w
        data = np.ascontiguousarray(data.T)
        logits = np.empty((steps, n, len(self.langs)), np.float32)
        for d in "fb":
            h = np.zeros((n, self.h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                h = self.step(np.take(w["x" + d], data[t], 0), h, d)[0]
                if d == "f":
                    logits[t] = h @ w["of"]
                else:
                    logits[t] += h @ w["ob"]
        logits += w["o"]
        np.exp(logits - logits.max(-1, keepdims=True), out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes], segment: int = SEGMENT, lanes: int = LANES) -> np.ndarray:
        """The mean distribution over all positions of each text; zeros for an empty one."""
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        n = -(-sizes // segment)
        owner = np.repeat(np.arange(len(texts)), n)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * segment
        length = np.minimum(sizes[owner] - at, segment)
        flat = np.frombuffer(b"".join(texts) + bytes(segment), np.uint8)
        first = (np.cumsum(sizes) - sizes)[owner] + at
        order = np.argsort(-length, kind="stable")  # segments of one length run together
        for lo in range(0, len(order), lanes):
            part = order[lo : lo + lanes]
            longest = int(length[part[0]])
            data = flat[first[part][:, None] + np.arange(longest)]
            inside = np.arange(longest)[None, :] < length[part][:, None]
            data = np.where(inside, data, 32)
            p = self.positions(data)
            np.add.at(out, owner[part], np.einsum("tnc,nt->nc", p, inside.astype(np.float32)))
        return out / np.maximum(sizes, 1)[:, None]


def training_sample(
    docs: DataFrame, lang_col: str, text_col: str, key: str, per_lang: int = SAMPLE_DOCS, crops: int = CROPS, crop: int = CROP
) -> DataFrame:
    """lang and crops of at most per_lang documents of each language, chosen by the hash of the column key.

    The places of the crops come from the hash too; whole texts are not shuffled.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    size = F.char_length(text_col)
    cut = [
        F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)), F.greatest(size - crop, F.lit(1))) + 1).cast("int"), F.lit(crop))
        for i in range(crops)
    ]
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), h.alias("h"), F.array(*cut).alias("crops"))
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang")
    # first within salts, so that no task ranks all documents of a language
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "crops")
    some = known.join(F.broadcast(langs), "lang", "left_semi").withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= per_lang)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "crops"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= per_lang)


def train(sample: DataFrame, crop: int = CROP, **how) -> ByteTagger | None:
    """A tagger from the bounded sample; None without labelled documents."""
    rows = sorted((r.lang, r.rank, list(r.crops)) for r in sample.collect())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    parts = [(r[0], c.encode()[:crop]) for r in rows for c in r[2]]
    data = np.stack([np.frombuffer(c.ljust(crop, b" "), np.uint8) for _, c in parts])
    labels = np.array([langs.index(k) for k, _ in parts])
    return ByteTagger(langs).fit(data, labels, **how)


def predict(docs: DataFrame, model: ByteTagger | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability, in one pass without a shuffle.

    A null text or one without a letter is und with score 0; so is every text if there is no model. Columns of docs
    with these two names are replaced.
    """
    keep = [c for c in docs.columns if c not in (pred, score)]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).withColumns({pred: F.lit(""), score: F.lit(0.0)}).schema
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if known:
                    p = model.documents([texts[i].encode() for i in known])
                    for i, k, s in zip(known, p.argmax(1), p.max(1), strict=True):
                        names[i], scores[i] = model.langs[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, pred, score])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    The tagger learns from rows that are not held out, from the MAX_LANGS languages with most of them. Language, source
    and id take no part in a prediction. A null id counts as not held out. A null text and one without a letter are und
    with score 0, and so is every text if nothing is labelled. Repeated rows are judged each for itself; other columns
    are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.withColumn("held_out", held_out("id"))
    model = train(training_sample(own.filter("not held_out"), "lang", "text", "id"))
    found = predict(own.select("id", "held_out", "text"), model)
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


#: A document is rejected below this probability.
LEAST_SCORE = 0.4


@sheltered
def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language go; the others keep their columns and rows as they are.

    A null text and one without a letter go. Repeated rows and null ids are judged each for itself. Without labelled
    documents, as in an empty table, nothing is recognised and nothing stays.
    """
    small_batches(spark)
    own = docs.withColumn("held_out", held_out("doc_id"))
    model = train(training_sample(own.filter("not held_out"), "lang", "text", "doc_id"))
    found = predict(docs, model, "text", "_lang_pred", "_score")
    return found.filter((F.col("_lang_pred") != UNDETERMINED) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)
