"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans that adds to them."""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import first_by_hash, in_small_batches, materialise

KINDS = ("email", "ip", "card", "phone")
#: What the field looks for besides; it has no base pattern and no part in the counts of the four kinds.
SECRET = "secret"
#: Bounded entities: words and characters that one entity of the field may span. Base matches have no bound.
MAX_WORDS, MAX_CHARS = 6, 320
#: The field learns from the documents, and from the runs of words in them, that come first by hash: about as many.
TRAINING_DOCS, TRAINING_RUNS = 15_000, 12_000

# A digit before would have begun the same match earlier, so these starts lose nothing and long digit runs stay linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that pass its test, by kind and start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_SIGN = re.compile(r"[0-9@]")
_LONG = re.compile(r"(?<!\S)\S{16,}")
_AT_DOT = re.compile(r"[\[(](?:at|dot)[\])]|\b(?:at|dot)\b", re.IGNORECASE)
_DOT = re.compile("dot", re.IGNORECASE)
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:", "\"'>]},;:.!?"
_CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "carte", "karte", "tarjeta"), "phone": ("tel", "phone", "call", "mobil", "fax", "whatsapp"), SECRET: ("password", "passwd", "pwd", "token", "secret", "key")}
_WHOLE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]| at ) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*"),
}
_KEY = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: What surely is a secret: values of named fields and keys with a known beginning. The field learns their looks from these.
_SEED = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{12,}={0,2})|\b(AKIA[0-9A-Z]{12,})\b")


def clusters(text: str):
    """Runs of successive words in which entities can be: words with a digit or an at sign, long ones, and spelt addresses.

    An "at" or "dot" counts in brackets, or where both are within three words; then its clean neighbours join the run.
    """
    found = {m.span() for m in _LONG.finditer(text)}
    end = 0
    while m := _SIGN.search(text, end):
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        found.add((start, end))
    spelt = [m.span() for m in _AT_DOT.finditer(text)] if _DOT.search(text) else []
    if not found and not spelt:
        return
    for k, (a, b) in enumerate(spelt):
        near = [s for s in spelt[max(0, k - 2) : k + 3] if text[s[0] : s[1]].lower().strip("[]()") != text[a:b].lower().strip("[]()") and abs(s[0] - a) < 80]
        if not near and text[a] not in "[(":
            continue
        found.add((a, b))
        end = a
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and not text[start - 1].isspace():
            start -= 1
        if start < end:
            found.add((start, end))
        if m := _WORD.search(text, b):
            found.add(m.span())
    run: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if run and a < run[-1][1]:
            continue
        if run and text[run[-1][1] : a].strip():
            yield run
            run = []
        run.append((a, b))
    if run:
        yield run


def segments(text: str, run: list[tuple[int, int]]):
    """Candidate entities of a run: (first word, word after, kind, start, end) of whole-span shapes, up to MAX_WORDS words."""
    for i in range(len(run)):
        if run[i][1] - run[i][0] >= 12:
            for m in _KEY.finditer(text, *run[i]):
                yield i, i + 1, SECRET, *m.span()
        for j in range(i + 1, min(len(run), i + MAX_WORDS) + 1):
            start, end = run[i][0], run[j - 1][1]
            while start < end and text[start] in _TRIM_LEFT:
                start += 1
            while end > start and text[end - 1] in _TRIM_RIGHT:
                end -= 1
            if end - start > MAX_CHARS:
                break
            span = text[start:end]
            for kind, shape in _WHOLE.items():
                if shape.fullmatch(span):
                    yield i, j, kind, start, end


def span_features(text: str, kind: str, start: int, end: int, words: int) -> list[str]:
    """What a whole candidate looks like."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - 24) : start].lower()
    f = [f"{kind}:bias", f"{kind}:words{words}", f"{kind}:cue" if any(c in before for c in _CUES[kind]) else f"{kind}:nocue"]
    if kind == "phone":
        f += [f"phone:{'intl' if span[0] == '+' or span.startswith('00') else 'local'}:{'area' if '(' in span else 'flat'}", f"phone:n{len(digits) if len(digits) < 17 else 17}"]
        f.append("phone:parts" + "-".join(str(len(p)) for p in re.split(r"\D+", span) if p)[:20])
    elif kind == "card":
        f += [f"card:n{len(digits)}", f"card:luhn{luhn(digits)}", f"card:{'grouped' if len(digits) != len(span) else 'flat'}", f"card:first{digits[0]}"]
    elif kind == "ip":
        f += [f"ip:valid{_is_ip(span)}"]
    elif kind == SECRET:
        classes = sum(any(test(c) for c in span) for test in (str.islower, str.isupper, str.isdigit))
        f += [f"secret:classes{classes}", f"secret:long{min(len(span) // 6, 6)}", f"secret:turns{min(len(re.findall('[0-9][A-Za-z]|[A-Za-z][0-9]', span)), 6)}", f"secret:{'digits' if span.isdigit() else 'hex' if re.fullmatch('[0-9a-f]+', span) else 'mixed'}", f"secret:known{span.startswith('AKIA')}"]
    else:
        f += [f"email:{'at' if '@' in span else 'spelt'}", f"email:tld{len(re.split(r'[.)]', span)[-1]) > 1}"]
    return f


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values)))


class Field:
    """Weights of span features; a sentence's labellings are its segmentations into entities and single other words."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, n: int, spans: list[tuple[int, int, float]]) -> list[int]:
        """Viterbi over segments: indices of the chosen spans (first, after, score); a word outside scores 0."""
        ends: dict[int, list[int]] = {}
        for k, s in enumerate(spans):
            ends.setdefault(s[1], []).append(k)
        value, choice = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ends.get(j, ()):
                v = value[spans[k][0]] + spans[k][2]
                if v > value[j]:
                    value[j], choice[j] = v, k
        out, j = [], n
        while j:
            if choice[j] < 0:
                j -= 1
            else:
                out.append(choice[j])
                j = spans[choice[j]][0]
        return out[::-1]

    @staticmethod
    def marginals(n: int, spans: list[tuple[int, int, float]]) -> list[float]:
        """Probability of each span by the semi-Markov forward and backward sums."""
        ends: dict[int, list[tuple[int, float]]] = {}
        starts: dict[int, list[tuple[int, float]]] = {}
        for a, b, s in spans:
            ends.setdefault(b, []).append((a, s))
            starts.setdefault(a, []).append((b, s))
        forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _logsum([forward[j - 1], *(forward[a] + s for a, s in ends[j])]) if j in ends else forward[j - 1]
        for i in range(n - 1, -1, -1):
            back[i] = _logsum([back[i + 1], *(back[b] + s for b, s in starts[i])]) if i in starts else back[i + 1]
        return [float(np.exp(forward[a] + s + back[b] - forward[n])) for a, b, s in spans]


def variants(kind: str, entity: str, pick: int) -> str | None:
    """Another way to write a base entity that its pattern misses: a spelt address, a number without the country's."""
    if kind == "email":
        at, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "))[pick % 3]
        local, domain = entity.rsplit("@", 1)
        return local + at + domain.replace(".", dot)
    if kind == "phone":
        parts = re.split(r"(?<=[0-9])[ .-]+(?=[(0-9])", entity.lstrip("+"), maxsplit=1)
        return (parts[1], f"00{entity.lstrip('+')}")[pick % 2] if len(parts) == 2 and len(_digits(parts[1])) >= 9 else None
    return None


def open_ended(kind: str, span: str) -> bool:
    """Looks that the base patterns and seeds cannot have, so that their silence says nothing: spelt addresses, numbers without a plus, bare keys."""
    if kind == SECRET:
        return len(span) >= 16 and len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", span)) >= 4
    return kind == "email" and "@" not in span or kind == "phone" and ("(" in span or span.startswith("00")) and 9 <= len(_digits(span)) <= 15


def _run_example(text: str, run, positive: set, unsure: list):
    found = list(segments(text, run))
    if not found or any(run[0][0] < e and s < run[-1][1] for s, e in unsure) or any(open_ended(k, text[s:e]) for _, _, k, s, e in found if not any(a <= s and e <= b for _, a, b in positive)):
        return None
    return len(run), [(i, j, span_features(text, k, s, e, j - i)) for i, j, k, s, e in found], [n for n, (_, _, k, s, e) in enumerate(found) if (k, s, e) in positive]


def examples(text: str):
    """Runs with a known answer: (words, [(first, after, features)], chosen spans).

    Base matches and seeds of secrets are the positive spans; each email and phone also comes a second time, written as
    the patterns miss it, between the words around it. A run in which a base pattern matched but failed its test (say two
    entities that it read as one), or in which something has looks that no pattern can have, says nothing, so it is left out; all else in a
    run of the text is no entity.
    """
    base = base_spans(text)
    positive = set(base) | {(SECRET, *m.span(1 if m[1] else 2)) for m in _SEED.finditer(text)}
    unsure = [m.span() for p, k in ((_CARD, "card"), (_PHONE, "phone")) for m in p.finditer(text) if len(_digits(m[0])) > 12 and (k, *m.span()) not in positive]
    for run in clusters(text):
        if example := _run_example(text, run, positive, unsure):
            yield example
    for n, (kind, start, end) in enumerate(base):
        if other := variants(kind, text[start:end], n + start):
            left, right = text[max(0, start - 40) : start], text[end : end + 40]
            left, right = re.sub(r"\S*[0-9@]\S*", "", left), re.sub(r"\S*[0-9@]\S*", "", right)
            shown = f"{left.rstrip()} {other} {right.lstrip()}".strip()
            at = shown.find(other)
            for run in clusters(shown):
                if run[0][0] < at + len(other) and at < run[-1][1] and (example := _run_example(shown, run, {(kind, at, at + len(other))}, [])) and example[2]:
                    yield example


def train(runs, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-3) -> dict[str, float]:
    """Conditional likelihood of the chosen spans by adaptive gradient steps; the same input gives the same weights.

    Equal runs are weighed together, so the work follows the distinct ones.
    """
    counts: dict = {}
    for n, spans, chosen in runs:
        key = (n, tuple((a, b, tuple(f)) for a, b, f in spans), tuple(chosen))
        counts[key] = counts.get(key, 0) + 1
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for (n, spans, chosen), times in counts.items():
            field = Field(weights)
            p = Field.marginals(n, [(a, b, field.score(f)) for a, b, f in spans])
            for k, (_, _, f) in enumerate(spans):
                d = times * ((k in chosen) - p[k])
                if abs(d) > 1e-6:
                    for x in f:
                        gradient[x] = gradient.get(x, 0.0) + d
        for x, g in sorted(gradient.items()):
            g -= ridge * len(runs) * weights.get(x, 0.0)
            seen[x] = seen.get(x, 0.0) + g * g
            weights[x] = weights.get(x, 0.0) + rate * g / (1e-6 + seen[x]) ** 0.5
    return weights


class Taken:
    """Whether a span crosses one of a text's base spans: they are merged and sorted once, so each question is one search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def crosses(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def sound(kind: str, span: str) -> bool:
    """The tests of the base kinds hold for what the field adds, too."""
    if kind == "card":
        return luhn(_digits(span))
    if kind == "ip":
        return _is_ip(span)
    return kind != "phone" or 9 <= len(_digits(span)) <= 15


def find(text: str, field: Field, least: float = 1.0) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the field's best segmentation adds those of score ``least`` that cross no base span."""
    base = base_spans(text)
    taken = Taken([(a, b) for _, a, b in base])
    extra = []
    for run in clusters(text):
        found = [c for c in segments(text, run) if not taken.crosses(c[3], c[4]) and sound(c[2], text[c[3] : c[4]])]
        if found:
            spans = [(i, j, field.score(span_features(text, k, s, e, j - i)) - least) for i, j, k, s, e in found]
            extra += [found[c][2:] for c in field.best(len(run), spans)]
    order = {k: n for n, k in enumerate((*KINDS, SECRET))}
    return base, sorted({*base, *extra}, key=lambda x: (order[x[0]], x[1], x[2]))


_EXAMPLE = pa.struct([("n", pa.int32()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("features", pa.list_(pa.string()))]))), ("chosen", pa.list_(pa.int32()))])


def _examples(batches):
    """(hash, text) -> the text's runs with a known answer, each with a hash of its own."""
    for batch in H.slices(batches, 1):
        rows, keys = [], []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, (n, spans, chosen) in enumerate(examples(t)):
                rows.append({"n": n, "spans": [{"first": a, "after": b, "features": f} for a, b, f in spans], "chosen": chosen})
                keys.append(f"{h}:{k}")
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, _EXAMPLE)], ["key", "e"])


def _find(sent):
    def run(batches):
        field = Field(sent.value)
        for batch in H.slices(batches, 1):
            rows = [find(t, field) for t in batch.column(1).to_pylist()]
            line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(line(base).encode()).hexdigest() for base, _ in rows], pa.string())
            known, secrets = ([line([s for s in every if (s[0] == SECRET) == other]) for _, every in rows] for other in (False, True))
            total = pa.array([len(every) for _, every in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array(known, pa.string()), pa.array(secrets, pa.string()), total], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "secret_spans", "n_spans"])

    return run


def learn(source: DataFrame, training_docs: int, training_runs: int) -> dict[str, float]:
    """The field's weights from a bounded sample of ``source`` (doc_id, text) with its base spans, seeds and variants."""
    keyed = source.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    runs = first_by_hash(keyed, F.col("h"), training_docs).mapInArrow(_examples, "key string, e struct<n: int, spans: array<struct<first: int, after: int, features: array<string>>>, chosen: array<int>>")
    runs = first_by_hash(materialise(runs, "pii-runs"), F.col("key"), training_runs)
    got = sorted(runs.collect(), key=lambda r: r["key"])
    return train([(r.e.n, [(v["first"], v["after"], v["features"]) for v in r.e.spans], r.e.chosen) for r in got])


@in_small_batches
def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_docs: int = TRAINING_DOCS, training_runs: int = TRAINING_RUNS) -> DataFrame:
    """Emails, IP addresses, card and phone numbers, and secrets of each row's whole text.

    Base spans are the fixed patterns' tested matches, and n_email, n_ip, n_card, n_phone and base_sha256 are of these. The
    semi-Markov field adds spans that the patterns miss: entities that run into each other, spelt addresses, numbers without
    the country's, keys and passwords. Over each run of telling words it chooses the best segmentation into entities of at
    most ``MAX_WORDS`` words and others. It learns from about ``training_docs`` documents and ``training_runs`` runs in them,
    those that come first by hash.

    Returns doc_id, the counts, base_sha256, spans (kind:start:end in code points, end exclusive, of the four kinds),
    secret_spans (the same of secrets) and n_spans (all of both). Null text is empty: no spans. Texts of any length are
    searched whole. Repeated rows give the same; other columns, whatever their names, are ignored; an empty table gives none.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(source, training_docs, training_runs))
    return source.mapInArrow(_find(sent), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secret_spans string, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
