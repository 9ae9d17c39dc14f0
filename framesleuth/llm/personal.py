"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Spans of four kinds are found by exact rules and always kept.  Looser forms of
the same kinds (numbers that miss a check, spelled-out addresses, phone numbers
without a plus) are candidates too.  Regular-expression, gazetteer and context
labelers vote for, against or not at all on every candidate; expectation
maximisation over the counts of all vote patterns estimates how far each labeler
of each kind can be trusted; a logistic span classifier learns the resulting
probabilities from the spans' shapes and neighbours, and adds candidates.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import slices
from framesleuth.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
#: Candidate spans that train the classifier, at most; the same at every run, those whose keys hash lowest.
SAMPLE_SPANS = 20_000
#: Probability from which the classifier adds a candidate.
CUT = 0.9
DIMENSIONS = 1 << 12
SLICE_BYTES = 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored at the start of a run of digits, so that long runs cost linear time.
_QUAD = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]+)+")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NUMBER = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])")
_CARD = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
_ABROAD = re.compile(r"(?<![0-9])00[1-9][ ().0-9-]{7,22}[0-9](?![0-9])")
#: Only texts that hold one of these can hold a candidate.
WORTH = r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]"

# Gazetteers: fixed values.
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at eu us ca au jp cn in br mx ru pl se no fi dk pt ie nz".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
SPECIAL_NETWORKS = ("0.", "255.")
# Words near a span that speak for its kind, in the languages of the corpus: fixed values.
NEAR = {
    "email": frozenset("email e-mail mail contact write correo courriel contacto adresse address".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address client addr adresse servidor serveur from gateway".split()),
    "card": frozenset("card cards visa mastercard amex credit debit payment tarjeta carte karte kreditkarte".split()),
    "phone": frozenset("tel phone telephone call mobile cell fax whatsapp sms telefon telefono telephon teléfono téléphone móvil handy".split()),
}
AGAINST = frozenset("version v ver release build token sha hash checksum key password secret order invoice isbn issn doi id serial page section rfc".split())
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _left_of(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def rule_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans ``(start, kind, end)`` by the exact rules, and what else lies in matches of their patterns that fail a check."""
    good, failed = [], []
    done, at = 0, text.find("@")
    while at >= 0:
        start = _left_of(text, at, done)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            good.append((start, 0, done := found.end()))
        at = text.find("@", max(at + 1, done))
    for m in _QUAD.finditer(text):
        (good if all(map(_byte, m.groups())) else failed).append((m.start(), 1, m.end()))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            good.append((m.start(), 2, m.end()))
        elif len(digits) >= 13:
            # The run may join a card to numbers beside it.
            inner = [(m.start() + x.start(), 2, m.start() + x.end()) for x in _CARD.finditer(m[0])]
            failed += inner or [(m.start(), 2, m.end())][: len(digits) <= 19]
    if "+" in text:
        for m in _PLUS.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            if 7 <= n <= 15:
                (good if n >= 10 else failed).append((m.start(), 3, m.end()))
            elif n > 15 and (inner := _NUMBER.match(m[0])):
                failed.append((m.start(), 3, m.start() + inner.end()))
    return sorted(good), failed


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans by the exact rules, and looser ones that overlap neither these nor each other."""
    good, loose = rule_spans(text)
    for m in _AT.finditer(text):
        start, found = _left_of(text, m.start(), 0), _SPELLED.match(text, m.end())
        if start < m.start() and found:
            loose.append((start, 0, found.end()))
    loose += [(m.start(), 1, m.end()) for m in _SIX.finditer(text)]
    loose += [(m.start(), 3, m.end()) for p in (_LOCAL_PHONE, _ABROAD) for m in p.finditer(text)]
    taken, kept = sorted((a, b) for a, _, b in good), []
    at = last = 0
    for a, kind, b in sorted(loose):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        # Taken spans from here on end after this one begins; of different kinds they may overlap each other.
        if a >= last and not any(x < b for x, _ in taken[at : at + 4]):
            kept.append((a, kind, b))
            last = b
    return good, kept


class Span:
    """What labelers and the classifier see of a span."""

    def __init__(self, text: str, start: int, kind: int, end: int):
        self.kind, self.text = KINDS[kind], text[start:end]
        self.digits = _only_digits(self.text)
        self.before, self.after = text[start - 1 : start], text[end : end + 1]
        near = _WORDS.findall(text[max(0, start - 40) : start].lower())
        self.left, self.near, self.right = (near[-1:] or [""])[0], frozenset(near[-4:]), (_WORDS.findall(text[end : end + 25].lower())[:1] or [""])[0]


def _rule(s: Span) -> int:
    """Regular expression: the strict form of the kind."""
    if s.kind == "email":
        return 1 if "@" in s.text else 0
    if s.kind == "ip":
        return 1 if ":" in s.text or all(map(_byte, s.text.split("."))) else -1
    if s.kind == "card":
        return 1 if luhn(s.digits) else -1
    return 1 if s.text[0] == "+" and 10 <= len(s.digits) <= 15 else -1 if len(s.digits) < 10 else 0


def _form(s: Span) -> int:
    """Regular expression: grouped as people write it, or of one digit only."""
    if len(set(s.digits)) == 1:
        return -1
    if s.kind == "card":
        return 1 if re.fullmatch(r"[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5}", s.text) else -1
    if s.kind == "phone":
        return 1 if re.search(r"[0-9]{3}[ .-][0-9]{3,4}", s.text) else 0
    return -1 if s.kind == "ip" and re.match(r"0[0-9]", s.text) else 0


def _edges(s: Span) -> int:
    """Regular expression: the span is a word of its own."""
    return -1 if (s.before.isalnum() or s.before in "_-./=#\\\"") and s.before or s.after and (s.after.isalnum() or s.after in "_%=\"") else 1


def _gazetteer(s: Span) -> int:
    """Gazetteer: top-level domains, card issuers, calling codes, networks without hosts."""
    if s.kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", s.text.rstrip(")]} "))[-1].lower() in DOMAINS else -1
    if s.kind == "ip":
        return -1 if s.text.startswith(SPECIAL_NETWORKS) else 0
    if s.kind == "card":
        return 1 if s.digits.startswith(ISSUERS) else -1
    number = s.digits[2:] if s.text.startswith("00") else s.digits
    return (1 if number.startswith(CALLING_CODES) else -1) if s.text[0] == "+" or s.text.startswith("00") else 0


def _for(s: Span) -> int:
    """Context: a word before it speaks for its kind."""
    return 1 if s.near & NEAR[s.kind] else 0


def _other(s: Span) -> int:
    """Context: a word before it names another kind of personal data or none."""
    return -1 if s.left in AGAINST or any(s.near & words for kind, words in NEAR.items() if kind != s.kind) else 0


LABELERS = (_rule, _form, _edges, _gazetteer, _for, _other)


def votes(s: Span) -> str:
    """A letter for each labeler: ``+`` for, ``-`` against, ``0`` none."""
    return "".join("0+-"[vote(s)] for vote in LABELERS)


def features(s: Span) -> list[int]:
    """Places of the span's features among the classifier's weights; always as many."""
    shape = re.sub(r"[0-9]+", lambda m: str(len(m[0])) + "d", re.sub(r"[A-Za-z]+", "a", s.text))[:60]
    edge = lambda c: "" if not c else "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c
    told = [
        "", shape, f"n{len(s.digits)}", f"d{len(set(s.digits))}", f"h{s.digits[:1]}", f"H{s.digits[:2]}", f"s{''.join(sorted(set(s.text) - set('0123456789')))[:20] if s.kind != 'email' else s.text.rpartition('.')[2]}",
        f"b{edge(s.before)}", f"a{edge(s.after)}", f"l{s.left}", f"r{s.right}", f"c{luhn(s.digits) if s.digits else ''}", f"w{bool(s.near & NEAR[s.kind])}{s.left in AGAINST}",
    ]
    return [zlib.crc32(f"{s.kind}\0{k}\0{x}".encode()) % DIMENSIONS for k, x in enumerate(told)]


def estimate(counts: dict[tuple[int, str], int], rounds: int = 100) -> dict[tuple[int, str], float]:
    """Probability that a span of each kind with each vote pattern is personal data, by EM.

    Given the truth, labelers vote independently; of each the chances of its three
    votes under either truth are estimated from the counts of all spans.  It
    starts from the majority of votes, and small pseudo-counts say that a vote
    for is more likely under truth than under falsehood.
    """
    import numpy as np

    out = {}
    for kind in sorted({k for k, _ in counts}):
        patterns = [p for k, p in counts if k == kind]
        n = np.array([counts[kind, p] for p in patterns], "f8")
        # cast[p, l, v]: whether pattern p has vote v of labeler l.
        cast = np.array([[[c == v for v in "0+-"] for c in p] for p in patterns], "f8")
        true = 1 / (1 + np.exp(-(cast[:, :, 1] - cast[:, :, 2]).sum(1)))
        for _ in range(rounds):
            log = []
            for share, trust in ((true, (1.0, 2.0, 0.5)), (1 - true, (1.0, 0.5, 2.0))):
                each = np.einsum("p,plv->lv", n * share, cast) + np.array(trust)
                log.append(np.log((n * share).sum() + 1) + np.einsum("plv,lv->p", cast, np.log(each / each.sum(1, keepdims=True))))
            true = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        out |= {(kind, p): float(x) for p, x in zip(patterns, true)}
    return out


def fit(places, wanted, rounds: int = 300, penalty: float = 1e-4):
    """Weights of a logistic classifier of sparse features that fits probabilities ``wanted``."""
    import numpy as np

    weights = np.zeros(DIMENSIONS)
    if not len(wanted):
        return weights
    width = places.shape[1]
    scale = np.bincount(places.ravel(), minlength=DIMENSIONS) / len(wanted) + 1e-3
    for _ in range(rounds):
        error = wanted - 1 / (1 + np.exp(-weights[places].sum(1)))
        slope = np.bincount(places.ravel(), np.repeat(error, width), DIMENSIONS) / len(wanted) - penalty * weights
        weights += 4 * slope / (scale * width)
    return weights


SPAN = "struct<start:long, kind:int, end:long, base:boolean, votes:string, features:array<int>>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the candidate ``spans`` of every row, with votes and features; whole texts, code points, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def told(text):
        good, loose = candidates(text)
        for base, spans in ((True, good), (False, loose)):
            for start, kind, end in spans:
                s = Span(text, start, kind, end)
                yield {"start": start, "kind": kind, "end": end, "base": base, "votes": votes(s), "features": features(s)}

    def task(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                texts = pc.fill_null(some.column(1), "")
                worth = pc.match_substring_regex(texts, WORTH).to_pylist()
                spans = [sorted(told(texts[k].as_py()), key=lambda s: (s["start"], s["kind"])) if w else [] for k, w in enumerate(worth)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(task, f"doc_id long, spans array<{SPAN}>")


def find_personal(docs: DataFrame, sample_spans: int = SAMPLE_SPANS, cut: float = CUT) -> DataFrame:
    """``doc_id`` and ``spans`` of every row: start, kind, end (code points), base, probability; by start, then kind.

    Spans by the exact rules have ``base`` true and are all kept.  Others are
    kept if the classifier gives them ``cut`` or more.  Vote patterns are counted
    over all candidates (a handful of letters each, so few patterns); at most
    ``sample_spans`` candidates train the classifier.  A null text counts as
    empty; empty tables, repeated rows and null ids are allowed, and other
    columns are left out.  Candidates are read by the result, so their table
    stays in the shared folder.
    """
    import numpy as np

    found, _ = scratch.write(find_candidates(docs), "candidates")
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    truth = estimate(counts)
    sample = each.select("kind", "votes", "features", F.xxhash64("doc_id", "start", "kind", "features").alias("key")).orderBy("key", "kind", "votes").limit(sample_spans).toArrow()
    places = np.array(sample.column("features").to_pylist() or np.zeros((0, 1)), "i8")
    weights = fit(places, np.array([truth[k, v] for k, v in zip(sample.column("kind").to_pylist(), sample.column("votes").to_pylist())]))

    def task(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                kept = []
                for s in spans:
                    p = 1 / (1 + np.exp(-weights[s["features"]].sum()))
                    if s["base"] or p >= cut:
                        kept.append({"start": s["start"], "kind": KINDS[s["kind"]], "end": s["end"], "base": s["base"], "probability": float(p)})
                out.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return found.mapInArrow(task, "doc_id long, spans array<struct<start:long, kind:string, end:long, base:boolean, probability:double>>")


def _number(kind: str):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and digest of the spans by rule, and all spans."""
    found = find_personal(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(_number, KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
