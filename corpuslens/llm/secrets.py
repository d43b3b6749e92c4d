"""Secret scans by grammar inference.

Rules find labelled credentials: values assigned to a telling name, access keys, long
hexadecimal runs. From all values of each kind, and all ordinary runs of the same
characters, states of a prefix tree are merged into probabilistic automata. Every other
run in the corpus is scored by how much likelier a credential's format makes it than an
ordinary run's; those above the threshold are findings too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.automata import Automaton, Growing
from corpuslens.llm.common import text_slices
from corpuslens.session import stage

KINDS = ("assign", "access", "hex")
LEARNED = "format"
#: How ordinary runs look; each look has an automaton of its own, so that rare looks are learned too.
LOOKS = ("lower", "title", "upper", "digits", "other")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    "(" + "|".join(_either(n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: A run that can be a credential; shorter ones carry too little evidence.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")


def look_of(run: str) -> int:
    if run.isdigit():
        return LOOKS.index("digits")
    if not run.isalpha():
        return LOOKS.index("other")
    if run.isupper():
        return LOOKS.index("upper")
    if run[1:].islower():
        return LOOKS.index("lower" if run[0].islower() else "title")
    return LOOKS.index("other")


def base_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, number of the kind, end, start of the value), by start, then kind; in code points."""
    found = []
    low = text.lower()
    if any(n in low for n in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Candidate runs that lie in none of the findings."""
    starts, reach = [], []
    for start, _, end, _ in found:
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else 0))
    out = []
    for m in CANDIDATE.finditer(text):
        at = bisect_right(starts, m.start())
        if not at or reach[at - 1] < m.end():
            out.append(m.span())
    return out


SCANNED = (
    "doc_id bigint, kind array<int>, start array<bigint>, stop array<bigint>, value array<string>, "
    "run_start array<bigint>, run array<string>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("text").to_pylist():
            text = text or ""
            found = base_findings(text)
            runs = other_runs(text, found)
            columns[0].append([f[1] for f in found])
            columns[1].append([f[0] for f in found])
            columns[2].append([f[2] for f in found])
            columns[3].append([text[f[3] : f[2]] for f in found])
            columns[4].append([a for a, _ in runs])
            columns[5].append([text[a:b] for a, b in runs])
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.list_(t)) for c, t in zip(columns, types)]],
            names=["doc_id", "kind", "start", "stop", "value", "run_start", "run"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): rule findings with their values, and all other candidate runs."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, SCANNED)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, text) of all values and other runs."""
    for batch in batches:
        kinds, values = batch.column("kind").flatten().to_pylist(), batch.column("value").flatten().to_pylist()
        runs = batch.column("run").flatten().to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([*kinds, *[len(KINDS) + look_of(r) for r in runs]], pa.int32()), pa.array([*values, *runs], pa.string())],
            names=["kind", "text"],
        )


def _log_sum(parts: list[float]) -> float:
    most = max(parts)
    return most + math.log(sum(math.exp(p - most) for p in parts))


@dataclass(frozen=True)
class SecretModel:
    """(log share, automaton) of the kinds of credentials and of the looks of ordinary runs, and the threshold."""

    credentials: list[tuple[float, Automaton]]
    ordinary: list[tuple[float, Automaton]]
    threshold: float

    def score(self, text: str) -> float:
        """Log of (probability of this string among credentials / among ordinary runs)."""
        secret, plain = (
            _log_sum([share + a.log_likelihood(text) for share, a in side]) for side in (self.credentials, self.ordinary)
        )
        return secret - plain


def _ease(automata: list[Automaton], text: str) -> float:
    """Log-probability a character under the automaton that explains the string best."""
    return max((a.log_likelihood(text) for a in automata), default=-math.inf) / (len(text) + 1)


#: Different (state, next characters) counted before a task hands them on.
HELD_COUNTS = 200_000
COUNTED = "kind int, state int, char string, gram string, n bigint"


def _counted(machines: dict[int, Growing]):
    """The next characters along all strings of a task, counted."""

    def rows(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["kind", "state", "char", "gram", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for kind, text in zip(batch["kind"].tolist(), batch["text"]):
                counts.update((kind, *step) for step in machines[kind].follow(text))
                if len(counts) > HELD_COUNTS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def _learned(strings: DataFrame, kinds: list[int], alpha: float) -> dict[int, Automaton]:
    """The automaton of each kind of (kind, text) from all its strings; a round of counting a depth, all kinds at once."""
    machines = {kind: Growing() for kind in kinds}
    open_kinds = list(kinds)
    while open_kinds:
        rows = strings.where(F.col("kind").isin(open_kinds)).mapInPandas(_counted({k: machines[k] for k in open_kinds}), COUNTED)
        sums = rows.groupBy("kind", "state", "char", "gram").agg(F.sum("n").alias("n")).collect()
        counts: dict[int, list] = {kind: [] for kind in open_kinds}
        for kind, state, char, gram, n in sums:
            counts[kind].append((state, char, gram, n))
        open_kinds = [kind for kind in open_kinds if machines[kind].settle(counts[kind], alpha)]
    return {kind: machine.automaton() for kind, machine in machines.items()}


def _rated(function):
    """(kind, text, rate) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["kind", "text"]].assign(rate=[function(t) for t in batch["text"]])

    return run, "kind int, text string, rate double"


def _quantile(rated: DataFrame, share: float) -> float | None:
    return rated.agg(F.percentile_approx("rate", share, 1_000_000)).first()[0]


def fit_secrets(scanned: DataFrame, alpha: float = 1e-6, odds: float = 100.0) -> SecretModel | None:
    """Automata, shares and threshold from all values of each kind of credential and all ordinary runs of each look.

    Automata learn from the different strings, so copies count once. Ordinary runs of mixed look that
    the credentials' automata explain as well as 99 of 100 of their own examples are not learned
    from: they may be credentials without a name. Shares are counted over all rows. Threshold: by its
    score and the numbers of both in the table, a finding is `odds` times likelier a credential than an
    ordinary run; and not below the score that 999 of 1,000 ordinary runs stay under. No credential,
    no model.
    """
    kinds = len(KINDS)
    flat = scanned.select("kind", "value", "run").mapInArrow(_strings, "kind int, text string")
    once = flat.groupBy("kind", "text").agg(F.count("*").alias("n"))
    # a few MB of strings are minutes of work: they must not end up in one task
    spark = scanned.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    strings = stage(once.repartition(tasks, "text"), "secret-strings")
    counts = {r["kind"]: r["n"] for r in strings.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    known = [kind for kind in sorted(counts) if kind < kinds]
    if not known:
        return None
    values, runs = strings.where(F.col("kind") < kinds).select("kind", "text"), strings.where(F.col("kind") >= kinds)
    automata = _learned(values, known, alpha)
    own = list(automata.values())
    ease, schema = _rated(lambda text: _ease(own, text))
    floor = _quantile(values.mapInPandas(ease, schema), 0.01)
    mixed = F.col("kind") == kinds + LOOKS.index("other")
    plain = runs.where(mixed).select("kind", "text").mapInPandas(ease, schema).where(F.col("rate") < floor)
    plain = stage(plain.select("kind", "text").unionByName(runs.where(~mixed).select("kind", "text")), "secret-plain")
    looks = sorted(r["kind"] for r in plain.select("kind").distinct().collect())
    automata |= _learned(plain, looks, alpha)

    def side(own: range) -> tuple[list[tuple[float, Automaton]], int]:
        total = sum(counts.get(k, 0) for k in own if k in automata)
        return [(math.log(counts[k] / total), automata[k]) for k in own if k in automata], total

    credentials, n_credentials = side(range(kinds))
    ordinary, n_ordinary = side(range(kinds, kinds + len(LOOKS)))
    model = SecretModel(credentials, ordinary or [(0.0, Automaton())], 0.0)
    score, schema = _rated(model.score)
    guard = _quantile(plain.mapInPandas(score, schema), 0.999)
    least = math.log(odds * max(1.0, n_ordinary / n_credentials))
    return replace(model, threshold=least if guard is None else max(least, guard))


FOUND = "doc_id bigint, spans array<struct<kind: string, start: bigint, stop: bigint, score: double>>"


def _scored(sent):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SecretModel | None = sent.value
        scores: dict[str, float] = {}

        def score(text: str) -> float:
            if text not in scores:
                if len(scores) >= 100_000:
                    scores.clear()
                scores[text] = model.score(text)
            return scores[text]

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("kind", "start", "stop", "value", "run_start", "run")]
            for kind, start, stop, value, run_start, runs in zip(*columns):
                spans = [(a, k, b, score(v) if model else None) for k, a, b, v in zip(kind, start, stop, value)]
                if model:
                    for a, text in zip(run_start, runs):
                        if (s := score(text)) > model.threshold:
                            spans.append((a, len(KINDS), a + len(text), s))
                spans.sort(key=lambda x: x[:3])
                out.append([{"kind": [*KINDS, LEARNED][k], "start": a, "stop": b, "score": s} for a, k, b, s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row: all findings by start, then kind, with the score of their value's format.

    `spans` has kind (`assign`, `access`, `hex` from the rules, `format` from the automata), start,
    stop (code points, exclusive) and score (log likelihood ratio; null where no credential in the
    table could be learned from). Null and empty texts have no spans; rows with null or equal ids are
    rows of their own; other columns are not read. An empty table gives no rows.
    """
    scanned = stage(scan_secrets(docs), "secret-scan")
    sent = docs.sparkSession.sparkContext.broadcast(fit_secrets(scanned))
    return scanned.mapInArrow(_scored(sent), FOUND)


def span_list(spans: Column, base: bool) -> Column:
    """`kind:start:stop`, joined by commas; `base`: of the rules' findings only."""
    kept = F.filter(spans, lambda s: s["kind"] != LEARNED) if base else spans
    each = F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(each, ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """doc_id, findings of each rule, digest of those, and all spans as text."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(F.col("spans"), True), 256).alias("base_sha256"),
        span_list(F.col("spans"), False).alias("spans"),
    )
