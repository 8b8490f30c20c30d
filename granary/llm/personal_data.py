"""Personal data: patterns propose spans, checksums confirm them, context words score them.

DataFrame functions only. Each kind has a pattern; its matches go leftmost
first without overlap, then a validator drops those that fail (no retries).
Card numbers must pass Luhn, bank account numbers (iban) mod 97. A span's
score starts at its kind's base and rises by CONTEXT_BONUS where one of the
kind's context words (English, German, Spanish, French) stands within CONTEXT
characters before it. The kinds ``email ip card phone`` are the base and always
stay; ``iban ssn secret key`` are added where their score reaches THRESHOLD.
An account number that passes mod 97 does by itself; a social security number
and a random-looking token do with context alone.

Spans are code points, end exclusive. Defined results: a null or empty text
has no spans; rows are judged one by one, so repeats and ties give equal rows;
an empty table gives no rows; other columns play no part. The patterns cannot
backtrack more than linearly, and matches are placed block by block, so long
texts with many matches are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
CONTEXT_BONUS = 0.35
THRESHOLD = 0.7


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_ok(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card_ok(match: Column) -> Column:
    digits = _digits(match)
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone_ok(match: Column) -> Column:
    return F.char_length(_digits(match)).between(9, 15)


def _iban_ok(match: Column) -> Column:
    """Mod 97 over the number with its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.pmod(rest * F.when(letter, 100).otherwise(10) + value, F.lit(97))

    return F.char_length(plain).between(15, 34) & (F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1)


def _secret_ok(match: Column) -> Column:
    """Letters and digits both, as random tokens have."""
    return match.rlike("[A-Za-z]") & (F.char_length(_digits(match)) >= 4)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, what a text with a valid match holds (a pattern, or one of some strings), its validator and context."""

    name: str
    pattern: str
    needs: str | tuple[str, ...]
    valid: object = None
    score: float = 0.6
    words: tuple[str, ...] = field(default=())
    base: bool = True


# Fixed values. A match of these patterns starts where a run of its characters starts, or where
# the last match ended; quantifiers are possessive where that changes no match. Matches take all the
# characters they can, so the least number of digits is asked by the patterns of card and phone already:
# shorter matches would be dropped, and no part of one is long enough.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), None, 0.65, ("e?-?mail", "contact", "kontakt", "correo", "courriel", "write to", "schreib")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _ip_ok, 0.6, ("ip", "host", "server", "address", "adresse", "servidor", "serveur", "dirección")),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", _card_ok, 0.65, ("card", "visa", "credit", "payment", "karte", "kredit", "zahlung", "tarjeta", "pago", "carte", "paiement")),
    Kind("phone", r"\+[0-9](?:[\x20().-]*+[0-9]){8,}+", r"\+[0-9](?:[\x20().-]*+[0-9]){8}", _phone_ok, 0.65, ("phone", "call", "tel", "mobile", "anruf", "handy", "llam", "móvil", "appel", "portable")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", _iban_ok, 0.7, ("iban", "account", "bank", "konto", "cuenta", "compte", "banco", "banque"), False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", None, 0.4, ("ssn", "social security"), False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", "[0-9](?:[A-Za-z+/_-]*+[0-9]){3}", _secret_ok, 0.4, ("token", "key", "secret", "passw", "credential", "schlüssel", "kennwort", "clave", "contraseña", "clé", "mot de passe"), False),
    Kind("key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9_])|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "PRIVATE KEY"), None, 0.9, ("key",), False),
)
#: Matches whose places are summed one by one before their sums are.
BLOCK = 128
BASE = tuple(k for k in KINDS if k.base)
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's confirmed spans in a text, in order."""
    # Between n matches lie n + 1 pieces; running sums of both lengths give the places. A fold that
    # grows an array copies it at each step, so it runs inside blocks, and once over the blocks' sums.
    both = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"),
    )
    pieces = F.transform(
        F.filter(both, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("size"), x["hit"].alias("hit")),
    )

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(x["hit"].alias("hit"), start.alias("start"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def skip(state: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def spans_of(pieces: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(BLOCK))
        return _let(
            F.transform(cuts, lambda c: F.slice(pieces, c, BLOCK)),
            lambda blocks: F.flatten(
                F.zip_with(
                    blocks,
                    F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), skip, lambda s: s["out"]),
                    lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<struct<hit:string,start:int,end:int>>").alias("out")), place, lambda s: s["out"]),
                )
            ),
        )

    found = _let(pieces, spans_of)
    if kind.valid:
        found = F.filter(found, lambda s: kind.valid(s["hit"]))

    def scored(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.lower(F.substr(text, low + 1, s["start"] - low))
        near = before.rlike(r"\b(?:" + "|".join(kind.words) + ")")
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    spans = F.transform(found, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    may = text.rlike(kind.needs) if isinstance(kind.needs, str) else reduce(or_, (F.contains(text, F.lit(n)) for n in kind.needs))
    return F.when(may, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, and per kind an array of (kind, start, end, score)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *[_spans(text, k).alias(k.name) for k in KINDS])


def redact(docs: DataFrame, mark: str = "█") -> DataFrame:
    """doc_id and the text with every base match's pattern replaced by its kind between marks.

    Confirmed spans only: the text between spans is kept as it is. Overlapping
    spans of several kinds are merged under the kind that starts first.
    """
    text = F.coalesce("text", F.lit(""))
    spans = F.sort_array(
        F.transform(F.concat(*[_spans(text, k) for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        kept = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        shown = F.when(inside, state["out"]).otherwise(F.concat(state["out"], kept, F.lit(mark), s["kind"], F.lit(mark)))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), shown.alias("out"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return docs.select("doc_id", done.alias("text"))


def _listed(kinds) -> Column:
    parts = F.concat(*[F.col(k.name) for k in kinds])
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_listed(BASE), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
        sum((F.size(k.name) for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
        F.array_join(F.transform(F.concat(*[F.col(k.name) for k in KINDS]), lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


#: SQL has no places of regular expression matches with these rules; tests hold it against brute force.
ORACLE_SQL: dict = {}
QUERIES = {"op10_personal_data": op10_personal_data}
