"""Secret scan with linking of multipart credentials.

Detectors find parts in whole texts: assignments, access identifiers and long hex strings (the base kinds,
always reported), endpoints, and weak candidates (bare 40-character keys, shorter hex strings, short assigned
values). Secrets (assignments, hex strings, weak candidates) are linked with access identifiers and endpoints by an
interval join: around a secret lies a scope of ``SCOPE`` characters each way, a complement is met if it reaches into
it. Both sides are cut into bins of ``SCOPE`` characters and joined by document and bin; matches of a kind do not
overlap, so a bin holds a bounded number of parts and no document's parts are paired as a whole. The nearest access
identifier and the nearest endpoint (ties: the earlier start) make the credential of a secret. Weak candidates are
reported only with a credential, endpoints only inside one's scope. An access identifier that overlaps the secret is
part of it and no complement; an endpoint that holds the secret is one.

Positions are sums of gaps and match lengths, added up in blocks of about the square root of the matches, so a text of
100 000 parts stays cheap. Repeated parts of repeated rows are counted before the join, so copies make no hot key.

Defined cases: NULL text is the empty text. Rows are told apart by doc_id and content; rows that repeat both are
returned as often as they occur, NULL ids too. Documents without parts give zero counts, empty spans and no credentials.
Very long texts are scanned whole. Other columns do not matter. Spans count code points, their end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import matches, scanned, whole, written

#: The base patterns of the contract.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Characters between a secret and its complement, and width of a bin.
SCOPE = 200
#: Kinds in the order in which ties of position are written: name, gate, pattern, role.
KINDS = (
    ("assign", "(?i:password|passwd|secret|token|api_?key)", ASSIGN, "base"),
    ("access", "AKIA", ACCESS, "base"),
    ("hex", HEX, HEX, "base"),
    ("endpoint", "://|\\d\\.\\d", "(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\x00-\\x20\"'<>]+|(?<![\\d.])(?:\\d{1,3}\\.){3}\\d{1,3}(?![\\d.])", "endpoint"),
    ("weak_key", "[A-Za-z0-9+/]{40}", "(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", "weak"),
    ("weak_hex", "[0-9a-f]{16}", "(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])", "weak"),
    ("weak_assign", "(?i:password|passwd|secret|token|api_?key)", ASSIGN, "weak"),
)
PARTS = "array<struct<start:int,end:int,kind:int>>"
NAMES = [name for name, *_ in KINDS]
ENDPOINT, ACCESS_KIND = NAMES.index("endpoint"), NAMES.index("access")
WEAK = [k for k, kind in enumerate(KINDS) if kind[3] == "weak"]
SECRETS = [NAMES.index("assign"), NAMES.index("hex"), *WEAK]
DOCUMENT = ["doc_id", "content"]


def _spans(text: Column, kind: int, pattern: str, lengths: tuple[int, int] | None) -> Column:
    """Matches as (start, end, kind); ``lengths`` bounds the second group."""
    def step(at: Column, r: Column) -> tuple[Column, Column, Column]:
        span = F.struct((at + r["gap"]).alias("start"), (at + r["gap"] + r["n"]).alias("end"), F.lit(kind).alias("kind"))
        return at + r["gap"] + r["n"], r["v"].between(*lengths) if lengths else F.lit(True), span

    return scanned(matches(text, F.lit(pattern), 2 if lengths else 0), F.lit(0), step, PARTS)


def parts(docs: DataFrame) -> DataFrame:
    """One row per distinct part, and one of kind -1 per document: doc_id, content, start, end, kind, copies."""
    text = F.col("_text")
    limits = {"assign": (6, 2**31 - 1), "weak_assign": (4, 5)}
    found = [F.when(F.rlike(text, F.lit(gate)), _spans(text, k, pattern, limits.get(name))).otherwise(F.array().cast(PARTS))
             for k, (name, gate, pattern, _) in enumerate(KINDS)]
    marker = F.array(F.struct(F.lit(0), F.lit(0), F.lit(-1))).cast(PARTS)
    rows = docs.select(F.col("doc_id"), whole().alias("_text"))
    # Text and hash end before the parts spread out: beside an explode they would be carried and computed per part.
    rows = rows.select("doc_id", F.xxhash64("_text").alias("content"), F.concat(marker, *found).alias("parts"))
    return rows.select(*DOCUMENT, F.explode("parts").alias("part")).select(*DOCUMENT, "part.*").groupBy(*DOCUMENT, "start", "end", "kind").agg(F.count(F.lit(1)).alias("copies"))


def scopes(found: DataFrame) -> DataFrame:
    """The interval join: secrets (doc_id, content, start, end, kind) with each complement (c_start, c_end, c_kind) in scope."""
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE))).alias("bin")
    secrets = found.where(F.col("kind").isin(SECRETS)).select(
        *DOCUMENT, "start", "end", "kind", bins(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    complements = found.where(F.col("kind").isin(ACCESS_KIND, ENDPOINT)).select(
        F.col("doc_id").alias("c_doc"), F.col("content").alias("c_content"), F.col("start").alias("c_start"), F.col("end").alias("c_end"),
        F.col("kind").alias("c_kind"), bins(F.col("start"), F.col("end")).alias("c_bin"))
    reached = (F.col("c_end") >= F.col("start") - SCOPE) & (F.col("c_start") <= F.col("end") + SCOPE)
    inside = (F.col("c_kind") == ACCESS_KIND) & (F.col("c_start") < F.col("end")) & (F.col("c_end") > F.col("start"))
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("content") == F.col("c_content")) & (F.col("bin") == F.col("c_bin"))
    return secrets.join(complements, same & reached & ~inside).select(*DOCUMENT, "start", "end", "kind", "c_start", "c_end", "c_kind")


def credentials(met: DataFrame) -> DataFrame:
    """One row per linked secret with its nearest access identifier and endpoint: structs of distance, start and end, or NULL."""
    distance = F.greatest(F.col("c_start") - F.col("end"), F.col("start") - F.col("c_end"), F.lit(0))
    near = lambda kind: F.min(F.when(F.col("c_kind") == kind, F.struct(distance.alias("distance"), F.col("c_start").alias("start"), F.col("c_end").alias("end"))))
    return met.groupBy(*DOCUMENT, "start", "end", "kind").agg(near(ACCESS_KIND).alias("access"), near(ENDPOINT).alias("endpoint"))


def secret_rows(docs: DataFrame) -> DataFrame:
    """One row per document with the digest columns of the query and its credentials, secret first, parts joined by ``+``."""
    names = F.array(*[F.lit(name) for name in NAMES])
    found = written(parts(docs), "secret-parts")
    met = scopes(found)
    part = lambda kind, s: F.concat_ws(":", F.lit(NAMES[kind]), s["start"], s["end"])
    link = F.concat_ws("+", part(ACCESS_KIND, F.col("access")), part(ENDPOINT, F.col("endpoint")))
    link = F.when(F.col("access").isNull(), part(ENDPOINT, F.col("endpoint"))).when(F.col("endpoint").isNull(), part(ACCESS_KIND, F.col("access"))).otherwise(link)
    none = F.lit(None)
    columns = [*DOCUMENT, "start", "end", "kind", "copies", "link"]
    base = found.where(F.col("kind") < ENDPOINT).withColumn("link", none.cast("string")).select(*columns)
    linked = credentials(met).withColumn("link", link).withColumn("copies", none.cast("bigint")).select(*columns)
    ends = met.where(F.col("c_kind") == ENDPOINT).select(*DOCUMENT, F.col("c_start").alias("start"), F.col("c_end").alias("end"), F.lit(ENDPOINT).alias("kind"),
                                                         none.cast("bigint").alias("copies"), none.cast("string").alias("link"))
    grouped = base.unionByName(linked).unionByName(ends).groupBy(*DOCUMENT).agg(
        F.max("copies").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("link").isNotNull(), F.struct("start", "kind", "end", "link")))).alias("links"))
    text = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    strong = F.filter("spans", lambda s: s["kind"] < ENDPOINT)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    linked_text = F.array_join(F.transform("links", lambda s: F.concat_ws("+", text(s), s["link"])), ",")
    return grouped.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(joined(strong), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), linked_text.alias("credentials"),
                          F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
