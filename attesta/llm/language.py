"""Missing or wrong document language labels (problem 8).

A byte convolutional network reads windows of WINDOW bytes: filters of several widths over the bytes, ReLU, the maximum
over the window, and a softmax over the languages. It is trained here in numpy on a bounded sample of the labelled rows,
whose labels are partly wrong: after a first fit the sentences that the network firmly holds for another language than
their label's are put aside and it is fitted again.

A text is cut into sentences; each has the log probabilities of its windows, and the most likely sequence of languages,
where a change of language costs SWITCH, joins them into segments. So a fragment that says little takes the language of
its neighbours.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


WINDOW = 80
WIDTHS = ((2, 24), (3, 40), (4, 40), (5, 32))
#: Labelled documents for each language, and sentences for each language, that the network is fitted on at most.
TRAIN_DOCS, TRAIN_SENTENCES = 700, 1200
#: Names of goods at most; each task holds them.
MOST_GOODS = 100_000
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.004, 5
#: Steps of a fit at least, however small the sample.
LEAST_STEPS = 600
#: Documents that make the label of a sentence sure, where they are three quarters of those that have it.
SEVERAL = 4
#: Cost of a change of language, in nats, and the most that one sentence can say for a language against another.
SWITCH, MOST = 1.0, 14.0
#: Distinct sentences that are scored together, and windows that are summed together.
BLOCK, CHUNK = 512, 24
#: Sentences whose score a task keeps for its next batches; it only saves work.
KEPT = 50_000

_TAG = re.compile(r"<[^<>]{0,200}>|&[a-z]{2,6};|\[/?[A-Z]{2,8}\]")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
_SOFT = re.compile(r"(?<![.!?…\s\"')\]])[ \t]*\n[ \t]*(?=[^\s\n])")
_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_END = re.compile(r"(?<=[.!?…])[\"'»”)\]]*(?:\s+|$)|\n+")
_SEPARATOR = re.compile(r"\s+(?:/+|[-–—]{2,}|\|)\s+")
_ZEROS = {ord(d): "0" for d in "123456789"}
_GAP = re.compile(r"[^\S\n]+")


class Goods:
    """Names of goods, found in one pass over a text by an automaton, and taken out of it where they stand as words, in any case."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names = sorted({" ".join(n.lower().split()) for n in names if n and n.strip()})
        self.automaton = None

    def _start(self) -> None:
        try:
            import ahocorasick
        except ImportError:
            self.automaton = re.compile("|".join(map(re.escape, sorted(self.names, key=len, reverse=True))))
            return
        self.automaton = ahocorasick.Automaton()
        for n in self.names:
            self.automaton.add_word(n, len(n))
        self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return {"names": self.names, "automaton": None}

    def without(self, t: str) -> str:
        if not self.names:
            return t
        if self.automaton is None:
            self._start()
        if "  " in t or "\t" in t or not t.isascii():
            t = _GAP.sub(" ", t)
        low = t.lower()
        if len(low) != len(t):  # a few capital letters become two signs
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
        if isinstance(self.automaton, re.Pattern):
            spans = [m.span() for m in self.automaton.finditer(low)]
        else:
            spans = [(end + 1 - n, end + 1) for end, n in self.automaton.iter(low)]
        out, at = [], 0
        for i, j in sorted(spans, key=lambda x: (x[0], -x[1])):
            if i >= at and not (i and low[i - 1].isalnum()) and not (j < len(low) and low[j].isalnum()):
                out += [t[at:i], " "]
                at = j
        return "".join(out) + t[at:] if at else t


NO_GOODS = Goods([])


def sentences(text: str | None, goods: Goods = NO_GOODS) -> list[str]:
    """The sentences of a text that hold a letter, without markup, addresses of the net and names of goods; any digit is a 0."""
    if not text:
        return []
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if not t.isascii():
        t = _UNSEEN.sub("", t)
    if "<" in t or "&" in t or "[" in t:
        t = _TAG.sub("\n", t)
    if "://" in t or "www." in t or "@" in t:
        t = _LINK.sub(" ", t)
    t = goods.without(t).translate(_ZEROS)
    if "\n" in t:
        t = _SOFT.sub(" ", t)
    parts = _END.split(t)
    if " /" in t or "|" in t or "--" in t or "–" in t or "—" in t:
        parts = [y for x in parts for y in _SEPARATOR.split(x)]
    return [s for s in (" ".join(x.split()).strip(" /|-–—") for x in parts) if s and any(map(str.isalpha, s))]


def windows(s: str) -> np.ndarray:
    """The windows of a sentence as an array (n, WINDOW) of bytes; the last one ends with the sentence."""
    b = (" " + s.lower() + " ").encode("utf-8")
    if len(b) <= WINDOW:
        return np.frombuffer(b.ljust(WINDOW), np.uint8)[None, :]
    starts = [*range(0, len(b) - WINDOW, WINDOW), len(b) - WINDOW]
    a = np.frombuffer(b, np.uint8)
    return np.stack([a[i : i + WINDOW] for i in starts])


class ByteNet:
    """Filters over bytes, maximum over the window, softmax."""

    def __init__(self, langs: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [rng.normal(0, 0.12, (w, 256, n)).astype(np.float32) for w, n in WIDTHS]
        self.bias = [np.zeros(n, np.float32) for _, n in WIDTHS]
        total = sum(n for _, n in WIDTHS)
        self.out = rng.normal(0, 0.1, (total, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maxima of the filters over each window, and where they are; CHUNK windows at a time, so that the sums stay in the cache."""
        tops, where = np.empty((len(x), sum(n for _, n in WIDTHS)), np.float32), [np.empty((len(x), n), np.intp) for _, n in WIDTHS]
        for k, part in self._chunks(x):
            at = 0
            for i, (a, b) in enumerate(self._sums(part)):
                top = a.argmax(axis=1)
                where[i][k] = top
                tops[k, at : at + len(b)] = np.take_along_axis(a, top[:, None, :], 1)[:, 0, :] + b
                at += len(b)
        return np.maximum(tops, 0, out=tops), where

    @staticmethod
    def _chunks(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of `x` with their bytes, short windows together: of the spaces after them a filter's width is enough."""
        length = WINDOW - (x[:, ::-1] != 32).argmax(axis=1)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(x), CHUNK):
            k = order[i : i + CHUNK]
            yield k, x[k, : min(WINDOW, int(length[k[-1]]) + WIDTHS[-1][0])].astype(np.intp)

    def _sums(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for (w, _), f, b in zip(WIDTHS, self.filters, self.bias):
            span = x.shape[1] - w + 1
            a = np.take(f[0], x[:, :span], axis=0)
            for j in range(1, w):
                a += np.take(f[j], x[:, j : j + span], axis=0)
            yield a, b

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """The log probabilities of each window."""
        h = np.empty((len(x), sum(n for _, n in WIDTHS)), np.float32)
        for k, part in self._chunks(x):
            h[k] = np.concatenate([a.max(axis=1) + b for a, b in self._sums(part)], 1)
        z = np.maximum(h, 0, out=h) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> "ByteNet":
        rng = np.random.default_rng(SEED)
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // BATCH)))
        params = [*self.filters, *self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            step = rate * (1 - 0.85 * epoch / max(1, epochs - 1))
            for i in range(0, len(x), BATCH):
                k = order[i : i + BATCH]
                xb, yb = x[k], y[k]
                h, where = self.pooled(xb)
                keep = (rng.random(h.shape) > 0.2).astype(np.float32) / 0.8
                hd = h * keep
                z = hd @ self.out + self.out_bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(k)), yb] -= 1
                p /= len(k)
                gh = (p @ self.out.T) * keep * (h > 0)
                grads = [np.zeros_like(f) for f in self.filters]
                gb, at = [], 0
                for g, (w, n), pos in zip(grads, WIDTHS, where):
                    part = gh[:, at : at + n]
                    at += n
                    gb.append(part.sum(0))
                    rows, cols = np.arange(len(k))[:, None], np.arange(n)[None, :]
                    for j in range(w):
                        place = (xb[rows, pos + j].astype(np.intp) * n + cols).ravel()
                        g[j] = np.bincount(place, part.ravel(), 256 * n).reshape(256, n)
                t += 1
                for q, (param, g) in enumerate(zip(params, [*grads, *gb, hd.T @ p, p.sum(0)])):
                    m[q] += 0.1 * (g - m[q])
                    v[q] += 0.001 * (g * g - v[q])
                    param -= step * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
        return self


def labelled(docs: DataFrame, language_names: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, title, lang) with `named`, the language that the label names, null where it names none."""
    names = {r[1].strip().lower(): r[0] for r in language_names.select("lang", "written_as").limit(10_001).collect() if r[0] and r[1]}
    if len(names) > 10_000:
        raise ValueError("language_names is no short list")
    pairs = [F.lit(x) for p in names.items() for x in p]
    return docs.select("doc_id", "text", F.col("title").alias("title"), (F.create_map(*pairs)[F.lower(F.trim("lang"))] if pairs else F.lit(None).cast("string")).alias("named"))


def training_texts(named: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str, float]]:
    """(text or title, language, documents that it stands for) of at most about `per_language` labelled documents for each language, chosen by a hash of the id."""
    known = named.filter(F.col("named").isNotNull() & (F.length("text") > 0))
    counts = {r[0]: r[1] for r in known.groupBy("named").agg(F.count("*")).collect()}  # one row a language
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("named") == lang) & (part < F.lit(min(1.0, per_language / n))))
    rows = known.filter(wanted).select("doc_id", "text", "title", "named").collect()
    return [(t, r["named"], max(1.0, counts[r["named"]] / per_language)) for r in sorted(rows, key=lambda r: r["doc_id"]) for t in (r["text"], r["title"]) if t]


def trained(texts: list[tuple], per_language: int = TRAIN_SENTENCES, goods: Goods = NO_GOODS) -> ByteNet | None:
    """The network fitted twice, or None without labelled sentences. Beyond `per_language` sentences the most frequent ones count."""
    langs = sorted({x[1] for x in texts})
    said: dict[str, dict[str, float]] = {}
    seen: dict[str, int] = {}
    # Labels are sampled alike, so what has a rare label by mistake would outweigh its own: each votes with what it stands for.
    for text, lang, *weight in texts:
        for s in sentences(text, goods):
            votes = said.setdefault(s, {})
            votes[lang] = votes.get(lang, 0) + (weight[0] if weight else 1.0)
            seen[s] = seen.get(s, 0) + 1
    # A sentence that documents of several labels share counts for the label of most of them.
    kept: dict[str, list[str]] = {lang: [] for lang in langs}
    for s, votes in sorted(said.items(), key=lambda x: (-seen[x[0]], x[0])):
        lang = max(sorted(votes), key=votes.__getitem__)
        if 2 * votes[lang] > sum(votes.values()) and len(kept[lang]) < per_language:
            kept[lang].append(s)
    x, y, sure = [], [], []
    for lang, ss in kept.items():
        for s in ss:
            plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
            for form in {s: 0, plain: 0}:  # accents are often left out
                w = windows(form)
                # What many documents say counts more, by the logarithm of their number.
                times = int(math.log2(seen[s])) + 1
                x += [w] * times
                y.append(np.full(len(w) * times, langs.index(lang)))
                # Wrong labels are scattered: what several documents of one label say is of its language.
                sure.append(np.full(len(w) * times, seen[s] >= SEVERAL and 4 * said[s][lang] >= 3 * sum(said[s].values())))
    if not x:
        return None
    xs, ys = np.concatenate(x), np.concatenate(y)
    first = ByteNet(langs).fit(xs, ys, epochs=2)
    lp = first.log_probs(xs)
    own = lp[np.arange(len(ys)), ys]
    sound = (own > lp.max(axis=1) - 1.0) | np.concatenate(sure)
    return ByteNet(langs).fit(xs[sound], ys[sound]) if sound.sum() >= 2 * len(langs) else first


def likeliest(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The most likely sequence of languages for sentences with log probabilities `scores`."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segments(named: DataFrame, net: ByteNet, goods: Goods = NO_GOODS) -> DataFrame:
    """(doc_id, named, seg_no, lang, confidence, n_sentences, n_segments): one row for each segment; none for a text without words.

    confidence is the mean probability that the segment's sentences have for its language, by length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # For each sentence its likeliest language, the probability of it, and the scores and probabilities of all.
        kept: dict[str, tuple[int, float, np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            cut = [sentences(t if isinstance(t, str) else None, goods) for t in pdf["text"]]
            fresh = [s for s in dict.fromkeys(s for c in cut for s in c) if s not in kept]
            for i in range(0, len(fresh), BLOCK):
                part = fresh[i : i + BLOCK]
                each = [windows(s) for s in part]
                lp = np.zeros((len(part), len(net.langs)))
                np.add.at(lp, np.repeat(np.arange(len(part)), [len(w) for w in each]), net.log_probs(np.concatenate(each)))
                lp = np.maximum(lp, lp.max(axis=1, keepdims=True) - MOST)
                prob = np.exp(lp - np.log(np.exp(lp).sum(axis=1, keepdims=True)))
                kept.update(zip(part, zip(lp.argmax(axis=1).tolist(), prob.max(axis=1).tolist(), lp, prob)))
            out = []
            for doc, name, c in zip(pdf["doc_id"], pdf["named"], cut):
                if not c:
                    continue
                found = [kept[s] for s in c]
                first = found[0][0]
                if all(x[0] == first for x in found):  # no change of language can be likelier
                    conf = sum(x[1] * len(s) for x, s in zip(found, c)) / sum(map(len, c))
                    out.append((doc, name, 1, net.langs[first], round(conf, 4), len(c), 1))
                    continue
                path = likeliest(np.array([x[2] for x in found]))
                edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                for no, (a, b) in enumerate(zip(edges, edges[1:]), 1):
                    conf = sum(x[3][path[a]] * len(s) for x, s in zip(found[a:b], c[a:b])) / sum(map(len, c[a:b]))
                    out.append((doc, name, no, net.langs[path[a]], round(float(conf), 4), b - a, len(edges) - 1))
            if len(kept) > KEPT:
                kept.clear()
            yield pd.DataFrame(out, columns=["doc_id", "named", "seg_no", "lang", "confidence", "n_sentences", "n_segments"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInPandas(run, f"doc_id {kind}, named string, seg_no int, lang string, confidence double, n_sentences int, n_segments int")


def save_network(spark: SparkSession, net: ByteNet, path: str) -> None:
    """The network as a table (name, shape, weights), to be used again."""
    parts = {**{f"filter{i}": f for i, f in enumerate(net.filters)}, **{f"bias{i}": b for i, b in enumerate(net.bias)}, "out": net.out, "out_bias": net.out_bias}
    rows = [(n, list(a.shape), a.ravel().tolist(), net.langs) for n, a in parts.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, weights array<float>, langs array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> ByteNet:
    """What save_network wrote."""
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}  # one row for each layer
    at = lambda n: np.array(rows[n]["weights"], np.float32).reshape(rows[n]["shape"])
    net = ByteNet(list(rows["out"]["langs"]))
    net.filters, net.bias = [at(f"filter{i}") for i in range(len(WIDTHS))], [at(f"bias{i}") for i in range(len(WIDTHS))]
    net.out, net.out_bias = at("out"), at("out_bias")
    return net


def goods_of(items: DataFrame, column: str = "item_name") -> Goods:
    """The names of goods in a table of at most MOST_GOODS of them."""
    names = [r[0] for r in items.select(column).distinct().limit(MOST_GOODS + 1).collect()]
    if len(names) > MOST_GOODS:
        raise ValueError(f"more than {MOST_GOODS} names of goods")
    return Goods(names)


def document_languages(docs: DataFrame, language_names: DataFrame, items: DataFrame | None = None, net: ByteNet | None = None) -> DataFrame:
    """(doc_id, named, seg_no, lang, confidence, n_sentences, is_case) for every document with words.

    is_case: the document has segments of several languages, or one that its label doesn't name. Null, blank and wordless
    texts give no row; without any labelled text there is nothing to learn from and no row comes out. items: goods whose
    names say nothing of a language. net: a fitted network; without one it is fitted on a sample of `docs`.
    """
    named = labelled(docs, language_names)
    goods = goods_of(items) if items is not None else NO_GOODS
    net = net or trained(training_texts(named), goods=goods)
    if net is None:
        return named.limit(0).selectExpr("doc_id", "named", "1 AS seg_no", "named AS lang", "CAST(0 AS DOUBLE) AS confidence", "0 AS n_sentences", "false AS is_case")
    return segments(named, net, goods).withColumn("is_case", (F.col("n_segments") > 1) | ~F.col("lang").eqNullSafe(F.col("named"))).drop("n_segments")


def confidence_report(found: DataFrame) -> DataFrame:
    """(tenth, n_segments, n_named, share_named): for each tenth of confidence how many segments of labelled documents have the language that the label names."""
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int").alias("tenth")
    agree = F.count_if(F.col("lang") == F.col("named"))
    return found.filter("named IS NOT NULL").groupBy(tenth).agg(F.count("*").alias("n_segments"), agree.alias("n_named"), F.round(agree / F.count("*"), 4).alias("share_named"))


def label_cases(found: DataFrame) -> DataFrame:
    return found.filter("is_case").select("doc_id", "seg_no", "lang")
