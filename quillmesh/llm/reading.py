"""Reading level of documents: regularised ordinal regression, calibrated to graded text.

Running text is what remains without code, tables, log lines, headings and marks. Each sentence is
measured (length, word length, long words, rarity of its words, connectives, clause marks), and the
document by the quartiles of its sentences, weighted by words, so a passage in another style
moves it little. Lexical diversity is a moving type-token ratio. Measures are standardised within the
document's language. A proportional-odds model with an L2 penalty is fitted to the graded documents.

Scale. One pass over the texts parses them; what is kept of each is four bytes a word, and lengths and clause marks of its
sentences. Word counts in a fixed number of hash buckets and the measures of whole batches of documents are taken from that.
What is collected is bounded: the buckets, a row of moments for each language, and at most
``max_graded`` graded feature vectors, taken by hash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.langid import language
from quillmesh.session import cut_lineage, spread

BUCKETS = 1 << 18
LEAST_WORDS = 60

_FENCED = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_TAGS = re.compile(r"<[^<>\n]{1,200}>")
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_TABLE = re.compile(r"^\s*\|.*\||^\s*[+|:=-]{3,}\s*$|\t.*\t|(?:\s\|\s.*){2,}")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\w{3} +\d+ \d\d:\d\d:\d\d)|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b[\s:\]]|^\s*at [\w.$]+\(|^\s*Traceback|(?:\b\w+=\S+\s+){2,}")
_CODE = re.compile(r"[;{}]\s*$|^\s*[{}\[\]()]+[,;]?\s*$|^\s*(?:def|class|import|from|return|for|while|if|else|elif|try|except|var|let|const|function|public|private|static|void|package|using|#include|SELECT|INSERT|UPDATE|CREATE)\b.*[:;({=]\s*|=>|->|::|==|!=|\+=|&&|\|\||^\s*\$ |^\s*[\w.-]+\s*=\s*\S|^\s*[\"']?[\w-]+[\"']?:\s*(?:[\[{\"'\d]|true|false|null)|^\s*- (?:match|name|id):|^\s*\w+\([^)]*\);?\s*$")
_HEAD = re.compile(r"^\s*(?:#{1,6}\s|==+\s|=+$|-+$|\*{3,}$)")
_MARK = re.compile(r"^\s*(?:>+\s*)*(?:[-*+•]\s+|\d{1,3}[.)]\s+|\[[\w .-]{1,20}\]\s*:?\s*|(?:Q|A|User|Bot|Assistant|System)\s*:\s+)?", re.I)
_SENT = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(¿¡\[]?[^\W\d_a-zß-ÿ]|[\d¿¡])|\n{2,}")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CLAUSE = re.compile(r"[,;:()–—]")
# Words that join clauses, by language.
_CONNECTIVES = frozenset(
    "because although though whereas while unless until since whether which whose whom whereby wherein thereby therefore thus hence however moreover furthermore nevertheless nonetheless notwithstanding "
    "inasmuch insofar conversely consequently accordingly provided albeit lest despite that if when before after once so "
    "porque embora conquanto enquanto porquanto portanto contudo todavia entretanto ademais outrossim porém conforme segundo caso quando desde antes depois cujo cuja cujos cujas qual quais que se logo pois senão não-obstante "
    "aunque mientras pues empero embargo además asimismo conque según cuando donde cuyo cuya cuyos cuyas cual cuales quien quienes porque siempre sino si tampoco "
    "parce quoique bien tandis lorsque puisque dont lequel laquelle ainsi donc cependant toutefois néanmoins afin weil obwohl während wenn dass damit sodass jedoch deshalb daher indem sobald bevor nachdem welche welcher".split()
)
FEATURES = 24


# What a line must have of to be a table, a log line or code.
_SUSPECT = re.compile(r"[|\t{}\[\]();=<>$&+:_!-]|\d\d|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE|Traceback)\b")


def running_text(text: str | None) -> str:
    """Prose without code, tables, log lines, headings, links and marks; paragraphs stay apart."""
    if not text:
        return ""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n\n", text)
    text = _URL.sub(" ", _TAGS.sub("", text) if "<" in text else text)
    lines = []
    for line in text.split("\n"):
        if not line.strip():
            lines.append("")
        elif _HEAD.match(line) or _SUSPECT.search(line) and (_TABLE.search(line) or _LOG.search(line) or _CODE.search(line)):
            lines.append("")
        else:
            body = _MARK.sub("", line, count=1)
            lines.append(("\n" if len(line) - len(line.lstrip()) + len(body) < len(line) and not line.lstrip().startswith(">") else "") + re.sub(r"[*`~]+|(?<!\w)_|_(?!\w)", "", body))
    return re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines))


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


class _Marks(dict):
    """What is kept of a word in 32 bits: its bucket (18 bits), its length up to 63 (6), whether it joins clauses (1), and more of its hash (7)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = m = bucket(word) | min(len(word), 63) << 18 | (word in _CONNECTIVES) << 24 | (xxhash.xxh32_intdigest(word, 1) & 127) << 25
        return m


_MARK_OF = _Marks()
SPAN = 50  # words in a window of lexical diversity


def parse(prose: str) -> tuple[np.ndarray, list[int], list[int], float]:
    """(marks of the words, words of each sentence, clause marks of each sentence, moving type-token ratio)."""
    words, lengths, clauses = [], [], []
    for p in _SENT.split(prose):
        if p and (found := _WORD.findall(p.lower())):
            words += found
            lengths.append(len(found))
            clauses.append(len(_CLAUSE.findall(p)))
    span = min(SPAN, len(words))
    windows = [len(set(words[i : i + span])) / span for i in range(0, len(words) - span + 1, max(1, span // 5))] if words else [0.0]
    return np.fromiter(map(_MARK_OF.__getitem__, words), np.uint32, len(words)), lengths, clauses, sum(windows) / len(windows)


def _quartiles(doc: np.ndarray, first: np.ndarray, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each document the quartiles of its sentences, weighted by words; ``first`` are the documents' first sentences."""
    order = np.lexsort((x, doc))
    x, weight = x[order], weight[order]
    total = np.cumsum(weight)
    before = np.r_[0.0, total[first[1:] - 1]]
    share = (total - np.repeat(before, np.diff(np.r_[first, len(x)]))) / np.repeat(np.add.reduceat(weight, first), np.diff(np.r_[first, len(x)]))
    at = np.arange(len(x))
    last = np.r_[first[1:], len(x)] - 1
    return np.stack([x[np.minimum(np.minimum.reduceat(np.where(share >= q - 1e-12, at, len(x)), first), last)] for q in (0.25, 0.5, 0.75)], axis=1)


def measures(marks: list[bytes], lengths: list, clauses: list, diversity: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The measures of documents with at least one sentence each, a row a document. ``rarity`` holds the information in bits of
    each bucket's words."""
    word = np.frombuffer(b"".join(marks), np.uint32)
    weight = np.concatenate(lengths).astype(float)
    n_sent = np.array([len(x) for x in lengths])
    doc = np.repeat(np.arange(len(lengths)), n_sent)
    first = np.r_[0, np.cumsum(n_sent)[:-1]]
    start = np.r_[0, np.cumsum(weight.astype(np.int64))[:-1]]
    each = lambda v: np.add.reduceat(v, start) / weight
    n_chars = (word >> np.uint32(18)) & np.uint32(63)
    joins = ((word >> np.uint32(24)) & np.uint32(1)).astype(float)
    length = np.log(weight)
    long, huge, join = each((n_chars >= 9).astype(float)), each((n_chars >= 12).astype(float)), each(joins)
    depth = np.log1p(np.concatenate(clauses) + join * weight)
    total = np.add.reduceat(weight, first)
    mean = lambda v: np.add.reduceat(v * weight, first) / total
    out = [_quartiles(doc, first, x, weight) for x in (length, each(n_chars.astype(float)), long, huge, each(rarity[word & np.uint32(BUCKETS - 1)].astype(float)), depth)]
    return np.c_[np.concatenate(out, axis=1), mean(join), diversity, mean(long), mean(huge), np.log(total), mean(length)]


_PARSED = "lang string, n_words int, marks binary, lengths array<int>, clauses array<int>, diversity double"


def _parse(least: int):
    def run(batches):
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                prose = running_text(text)
                marks, lengths, clauses, diversity = parse(prose)
                if len(marks):
                    lang = language(prose) or "xx" if len(marks) >= least else None
                    out.append((doc, lang, len(marks), marks.tobytes(), lengths, clauses, diversity))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "n_words", "marks", "lengths", "clauses", "diversity"])

    return run


def _count_words(batches):
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
        total = np.bincount((words & np.uint32(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def _measure(rarity):
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                x = measures(list(part["marks"]), list(part["lengths"]), list(part["clauses"]), part["diversity"].to_numpy(), rarity.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang": part["lang"].to_numpy(), "n_words": part["n_words"].to_numpy(), "x": list(x)})

    return run


def _expand(z: np.ndarray) -> np.ndarray:
    """Clipped measures and what bends: squares of the medians of length, word length and depth, and their product."""
    z = np.clip(z, -4, 4)
    a, b, c = z[:, 1], z[:, 4], z[:, 16]
    return np.c_[z, a * a, b * b, c * c, a * b, np.maximum(a, b), np.minimum(a, b)]


class OrdinalRegression:
    """Proportional odds with an L2 penalty, fitted by damped gradient steps (Adam) from zero; deterministic."""

    def __init__(self, levels: int = 3, penalty: float = 1e-3, steps: int = 1500, rate: float = 0.05):
        self.levels, self.penalty, self.steps, self.rate = levels, penalty, steps, rate

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "OrdinalRegression":
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        weight = weight / weight.sum()
        share = np.clip(np.cumsum([weight[y == k].sum() for k in range(1, self.levels)]), 0.01, 0.99)
        first = np.log(share / (1 - share))
        p = np.r_[np.zeros(d), first[0], np.log(np.maximum(np.diff(first), 0.1))]
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, self.steps + 1):
            cuts = p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]
            edge = np.concatenate([[-40], cuts, [40]])
            score = x @ p[:d]
            up, lo = 1 / (1 + np.exp(-np.clip(edge[y] - score, -40, 40))), 1 / (1 + np.exp(-np.clip(edge[y - 1] - score, -40, 40)))
            chance = np.maximum(up - lo, 1e-9)
            du, dl = up * (1 - up) / chance * weight, lo * (1 - lo) / chance * weight
            grad = np.zeros_like(p)
            grad[:d] = x.T @ (du - dl) + self.penalty * p[:d]
            to_cut = np.array([-du[y == k].sum() + dl[y == k + 1].sum() for k in range(1, self.levels)])
            grad[d] = to_cut.sum()
            for j in range(1, self.levels - 1):
                grad[d + j] = to_cut[j:].sum() * np.exp(p[d + j])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            p = p - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.coef, self.cuts = p[:d], p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x)[:, None] > self.cuts[None, :]).sum(axis=1)


PRIOR_DOCS = 30  # moments of a language count as many documents of the whole beside its own


def shrunken(counts: dict, means: dict, squares: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation for each language, drawn towards those of all documents the more the fewer documents it has. Key ``all`` has
    those of all documents."""
    out = {}
    for lang, n in counts.items():
        k = 0 if lang == "all" else PRIOR_DOCS
        mean = (n * means[lang] + k * means["all"]) / (n + k)
        square = (n * squares[lang] + k * squares["all"]) / (n + k)
        out[lang] = (mean, np.sqrt(np.maximum(square - mean**2, 1e-12)))
    return out


def _standard(x: np.ndarray, lang: list[str], moments: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.empty_like(x)
    for one in set(lang):
        at = np.array([v == one for v in lang])
        mean, dev = moments.get(one) or moments["all"]
        out[at] = (x[at] - mean) / dev
    return out


def _grade(model, moments):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _expand(_standard(np.stack(pdf["x"].to_list()).astype(float), list(pdf["lang"]), moments))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "reading_level": model.predict(x).astype(np.int32), "score": model.score(x), "n_words": pdf["n_words"]})

    return run


def measured(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, lang, n_words, x) of documents with enough running text, checkpointed. The words of all documents count for rarity."""
    spark = docs.sparkSession
    texts = spread(docs.where("doc_id is not null and text is not null").select("doc_id", "text"))
    kind = dict(docs.dtypes)["doc_id"]
    parsed = cut_lineage(texts.mapInPandas(_parse(least_words), f"doc_id {kind}, {_PARSED}"))
    counts = parsed.select("marks").mapInArrow(_count_words, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(BUCKETS, 0.5)
    table[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    rarity = spark.sparkContext.broadcast((np.log2(max(table.sum(), 2.0)) - np.log2(table)).astype(np.float32))
    enough = parsed.where(F.col("n_words") >= least_words)
    return cut_lineage(enough.mapInPandas(_measure(rarity), f"doc_id {kind}, lang string, n_words int, x array<double>"))


def reading_levels(docs: DataFrame, labels: DataFrame, *, least_words: int = LEAST_WORDS, max_graded: int = 50_000, penalty: float = 1e-3) -> DataFrame:
    """(doc_id, reading_level, score, n_words) for every document with at least ``least_words`` words of running text.

    docs: doc_id, text; labels: doc_id, reading_level (1, 2 or 3), a row for each grader. Grades outside
    1 to 3 and null ones are left out; of several graders the median counts, and documents whose graders
    agree weigh more. At most ``max_graded`` graded documents, taken by hash, are fitted on. Without
    any graded document the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    x = measured(docs, least_words)
    mean, square = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(FEATURES)], [F.avg(F.col("x")[i] * F.col("x")[i]).alias(f"s{i}") for i in range(FEATURES)]
    rows = x.select(F.lit("all").alias("lang"), "x").unionAll(x.select("lang", "x")).groupBy("lang").agg(F.count("*").alias("n"), *mean, *square).collect()
    moments = shrunken({r.lang: r.n for r in rows}, *({r.lang: np.array([r[f"{k}{i}"] for i in range(FEATURES)]) for r in rows} for k in "ms"))
    grades = labels.where("reading_level between 1 and 3").groupBy("doc_id").agg(F.sort_array(F.collect_list("reading_level")).alias("given"))
    graded = x.join(grades.hint("merge"), "doc_id").orderBy(F.xxhash64("doc_id")).limit(max_graded).select("lang", "x", "given").collect()
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, reading_level int, score double, n_words int"
    if not graded:
        return spark.createDataFrame([], schema)
    given = [list(r.given) for r in graded]
    y = np.array([g[(len(g) - 1) // 2] if len(g) % 2 or g[0] == g[-1] else round(float(np.mean(g)) + 1e-9) for g in given])
    weight = np.array([1.0 if len(g) == 1 else 2.0 if len(set(g)) == 1 else 0.5 for g in given])
    z = _expand(_standard(np.array([r.x for r in graded], float), [r.lang for r in graded], moments))
    model = OrdinalRegression(penalty=penalty).fit(z, y, weight)
    return x.mapInPandas(_grade(model, moments), schema)
