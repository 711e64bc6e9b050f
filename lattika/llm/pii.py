r"""Personal data by weak supervision (DataFrame functions only).

Candidates are the matches of four base patterns, valid or not, and of looser
patterns (obfuscated e-mail, national phone, IPv6). Four labelers vote on each:
the pattern's validity check, a gazetteer (top domains, country codes, issuer
prefixes, address blocks), context words to the left, and the edges. Expectation
maximisation over the counts of vote patterns (at most 3**4 for each kind, over
all documents) estimates every labeler's reliability and the candidates' labels;
from these soft labels a logistic span classifier is trained on the same bounded
table. Its score decides on every match of a looser pattern that no valid base match
overlaps. Valid base matches always stay, and base matches that fail their check only
serve to estimate.

Everything is computed within a document's row: no shuffle but of the counts.
A run of n matches costs n**1.5 at most for its offsets, other work is linear:
patterns start at the edge of a run only, and repeated groups are possessive.

Defined results: null text counts as empty (no spans); ties can't occur, spans of
a kind don't overlap; repeated rows give repeated rows; an empty table gives no
rows; other columns are ignored. A text is searched whole, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import let, running

KINDS = ("email", "ip", "card", "phone")
# Base patterns. \G: where the last match ended; a match that could start within a run starts at its edge as well.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20/]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
NEEDS = {"email": r"@|\bat\b", "ip": r"[0-9A-Fa-f][.:]", "card": r"[0-9][\x20./-]*[0-9]", "phone": r"[0-9]"}
#: Gazetteers: fixed values.
GAZETTEER = {
    "email": r"(?i)[. ](com|org|net|edu|gov|int|mil|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|jp|cn|in|br|ch|at|be|se|no|dk|fi|pl|pt|ru)$",
    "ip": r"^(?!0+\.)(0*(?:1?[0-9]?[0-9]|2[0-1][0-9]|22[0-3]))\.|^(20|2[4-9A-Fa-f]|fe80|FE80|fd|FD)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|65|64[4-9]|35)",
    "phone": r"^\+?(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])\b|^\(?[2-9][0-9]{2}\)?[\x20.-]",
}
CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write to|mailto|reply|correo|courriel|kontakt)",
    "ip": r"(?i)(\bip\b|address|host|server|addr|gateway|dns)",
    "card": r"(?i)(card|visa|amex|payment|credit|debit|carte|karte|tarjeta)",
    "phone": r"(?i)(phone|\btel|call|mobile|fax|whatsapp|telefon|llam)",
}
AGAINST = r"(?i)(version|token|secret|hash|sha|md5|isbn|ticket|invoice|order|serial)\W*$"
LABELERS = ("valid", "gazetteer", "context", "edges")
TRUST = 0.5  # pseudo-counts of the check, as a share of all candidates


def _starts(found: Column, pieces: Column) -> Column:
    """Offsets of matches, from the matches and the pieces between them."""
    lens = F.zip_with(pieces, found, lambda p, m: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
    before = lambda w: F.transform(found, lambda _, i: (F.element_at(w, i + 1) + F.length(F.element_at(pieces, i + 1))).cast("int"))
    return F.when(F.size(found) > 0, let(running(lens), before)).otherwise(F.array().cast("array<int>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled and cast out, is a multiple of ten."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    part = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(part, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _matches(kind: str, text: Column, pattern: str, loose: bool) -> Column:
    """array<struct(start, stop, valid, votes)> of a pattern's matches in text."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def described(ms: Column) -> Column:
        def spans(starts: Column) -> Column:
            def one(m: Column, s: Column) -> Column:
                right = _valid(kind, m)
                left = F.substring(text, F.greatest(s - 39, F.lit(1)), F.least(s, F.lit(40)))
                near = F.concat(F.substring(text, s, F.when(s > 0, 1).otherwise(0)), F.lit("|"), F.substring(text, s + F.length(m) + 1, F.lit(1)))
                # Obfuscated addresses and IPv6 have no check of their own.
                v1 = F.lit(2) if loose and kind in ("email", "ip") else F.when(right, 1).otherwise(0)
                v2 = F.when(m.rlike(GAZETTEER[kind]), 1).otherwise(0)
                v3 = F.when(left.rlike(CONTEXT[kind]), 1).when(left.rlike(AGAINST), 0).otherwise(2)
                v4 = F.when(near.rlike(r"[\p{L}0-9]"), 0).otherwise(1)
                valid = F.lit(False) if loose else right
                return F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), valid.alias("valid"), F.lit(loose).alias("loose"), F.array(v1, v2, v3, v4).alias("votes"))

            return F.zip_with(ms, starts, one)

        return let(_starts(ms, pieces), spans)

    empty = F.array().cast("array<struct<start:int,stop:int,valid:boolean,loose:boolean,votes:array<int>>>")
    return F.when(text.rlike(NEEDS[kind]), let(found, described)).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a column for each kind: base and loose candidates with votes, loose ones clear of valid base ones."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", *[_matches(k, F.col("t"), BASE[k], False).alias(f"b_{k}") for k in KINDS], *[_matches(k, F.col("t"), LOOSE[k], True).alias(f"l_{k}") for k in KINDS])

    def clear(k: str) -> Column:
        # Base matches are in order, so those that could overlap are few; most documents have none.
        free = F.filter(f"l_{k}", lambda x: ~F.exists(f"b_{k}", lambda b: b["valid"] & (b["start"] < x["stop"]) & (b["stop"] > x["start"])))
        return F.when(F.size(f"l_{k}") == 0, F.col(f"b_{k}")).otherwise(F.concat(f"b_{k}", free)).alias(k)

    return d.select("doc_id", *[clear(k) for k in KINDS])


def vote_counts(cands: DataFrame) -> dict[str, dict[tuple[int, ...], int]]:
    """Counts of vote patterns by kind: at most 81 rows a kind, whatever the input."""
    def pattern(k: str) -> Column:
        return F.transform(k, lambda c: F.struct(F.lit(k).alias("kind"), F.array_join(F.transform(c["votes"], lambda v: v.cast("string")), "").alias("votes")))

    each = cands.select(F.explode(F.concat(*map(pattern, KINDS))).alias("c"))
    out: dict[str, dict[tuple[int, ...], int]] = {k: {} for k in KINDS}
    for r in each.groupBy("c.kind", "c.votes").count().collect():
        out[r["kind"]][tuple(int(x) for x in r["votes"])] = r["count"]
    return out


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 30) -> tuple[dict[tuple[int, ...], float], list[list[list[float]]]]:
    """Soft label of each vote pattern, and P(vote | label) of each labeler, by expectation maximisation."""
    soft = {v: (0.5 + sum(1 if x == 1 else -1 if x == 0 else 0 for x in (v[0], *v))) / (1 + sum(x != 2 for x in (v[0], *v))) for v in counts}
    soft = {v: min(0.95, max(0.05, 0.5 + 0.45 * p)) for v, p in soft.items()}
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        table, total = [], sum(counts.values())
        for j in range(len(LABELERS)):
            rows = []
            for label in (0, 1):
                # A labeler is held to be right more often than not: a pseudo-count on the diagonal, and for
                # the check, which unlike the others can't be right by the look of things, many.
                sums = [1.0 + (TRUST * total if j == 0 else 1.0) * (v == label) for v in range(3)]
                for pattern, n in sorted(counts.items()):
                    sums[pattern[j]] += n * (soft[pattern] if label else 1 - soft[pattern])
                rows.append([s / sum(sums) for s in sums])
            table.append(rows)
        prior = (1 + sum(n * soft[v] for v, n in sorted(counts.items()))) / (2 + total)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][x] / table[j][0][x]) for j, x in enumerate(v))
            soft[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return soft, table


def train(counts: dict[tuple[int, ...], int], soft: dict[tuple[int, ...], float], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier: bias, then (vote is 0, vote is 1) of each labeler."""
    w, total = [0.0] * (1 + 2 * len(LABELERS)), max(1, sum(counts.values()))
    for _ in range(rounds):
        grad = [decay * x for x in w]
        for v, n in sorted(counts.items()):
            x = [1.0] + [float(vote == c) for vote in v for c in (0, 1)]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, f in enumerate(x):
                grad[i] += n / total * (p - soft[v]) * f
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and all spans by kind (arrays of start, stop): one row per row of docs."""
    cands = candidates(docs, id_col, text_col)
    counts = vote_counts(cands)
    weights = {k: train(c, estimate(c)[0]) if (c := counts[k]) else [0.0] * 9 for k in KINDS}

    def keep(k: str, c: Column) -> Column:
        w, score = weights[k], F.lit(weights[k][0])
        for j in range(len(LABELERS)):
            score = score + F.when(c["votes"][j] == 0, w[1 + 2 * j]).when(c["votes"][j] == 1, w[2 + 2 * j]).otherwise(0.0)
        return c["valid"] | (c["loose"] & (score > 0))

    def pair(c: Column) -> Column:
        return F.struct(c["start"], c["stop"])

    base = [F.transform(F.filter(k, lambda c: c["valid"]), pair).alias(f"base_{k}") for k in KINDS]

    def kept(k: str) -> Column:
        return F.array_sort(F.transform(F.filter(k, lambda c: keep(k, c)), pair)).alias(f"all_{k}")

    return cands.select("doc_id", *base, *map(kept, KINDS))


def pii_digest(docs: DataFrame) -> DataFrame:
    d = find_pii(docs)

    def shown(prefix: str, k: str) -> Column:
        return F.transform(f"{prefix}_{k}", lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["stop"].cast("string")))

    def joined(prefix: str) -> Column:
        return F.array_join(F.concat(*[shown(prefix, k) for k in KINDS]), ",")

    return d.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
