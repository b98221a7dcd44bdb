"""Quality rules by host.

Every document is held against rules of the kinds that C4 and Gopher made known; failures are counted by host; a host's
rate is shrunk towards a beta prior that is fitted to all hosts; and the host's verdict decides what becomes of its
documents.

A rule fails a document, from MIN_WORDS or MIN_LINES on where it says so, that has
few_words     fewer words than FEW_WORDS
symbols       more than 6 % of its characters among SYMBOLS
capitals      10 words and more than 30 % of its characters among A to Z
no_letters    MIN_WORDS and more than a fifth of its words without a letter of any script
word_length   MIN_WORDS and words of fewer than 2 or more than 15 characters on average
long_words    more than 40 characters, white space included, for each word
same_words    MIN_WORDS and less than a fifth of them different
same_lines    MIN_LINES and less than half of them different
bullets       MIN_LINES and more than 90 % of them starting with a bullet
ellipses      MIN_LINES and more than 30 % of them ending with an ellipsis
filler        the words lorem ipsum
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FEW_WORDS, MIN_WORDS, MIN_LINES = 2, 20, 4
SYMBOLS, CAPITALS, LETTER, WHITE = "[*$#&%|!{}<>~^]", "[A-Z]", r"\p{L}", " \t\n\x0b\f\r"
BULLET, ELLIPSIS, FILLER = "^[ \\t]*[-*\u2022]", "(\\.\\.\\.|\u2026)[ \\t\\r]*$", "[Ll]orem ipsum"
#: The authority of a URL without user, port and a leading www.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[Ww]{3}\.)?([^/?#@:]+)"
#: Shrunk rates below TRUSTED forgive a document one failed rule; from BLOCKED on all documents of the host go.
TRUSTED, BLOCKED = 0.02, 0.8
#: Documents that the prior is worth if nothing can be told (a single host, or one rate for all), and at most.
PRIOR, MOST_PRIOR = 10.0, 1000.0


def host_of(value: Column) -> Column:
    """The host of a URL, in lower case; a value that is no URL is a host's name already and stays as it is."""
    value = value.cast("string")
    host = F.lower(F.regexp_extract(value, HOST, 1))
    return F.when(host != "", host).otherwise(value)


def counts(text: Column) -> dict[str, Column]:
    """What the rules look at, each counted once. A null text is like an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def like(xs: Column, pattern: str) -> Column:
        return F.size(F.filter(xs, lambda x: x.rlike(pattern)))

    def several(xs: Column, patterns: dict[str, str]) -> Column:
        """Number, number of distinct ones (hashed, as strings would be compared pair by pair) and of those like each pattern."""
        distinct = F.size(F.array_distinct(F.transform(xs, lambda x: F.xxhash64(x))))
        return F.struct(F.size(xs).alias("n"), distinct.alias("distinct"), *(like(xs, p).alias(k) for k, p in patterns.items()))

    once = lambda xs, **patterns: F.get(F.transform(F.array(xs), lambda x: several(x, patterns)), 0)  # noqa: E731  (a variable is evaluated once)
    return {
        "size": F.length(text),
        "solid": F.length(F.translate(text, WHITE, "")),
        "symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "capitals": F.regexp_count(text, F.lit(CAPITALS)),
        "filler": text.rlike(FILLER),
        "words": once(F.filter(F.split(F.btrim(text, F.lit(WHITE)), "[ \t\n\x0b\f\r]+"), lambda w: w != ""), letters=LETTER),
        "lines": once(F.split(text, "\n"), bullets=BULLET, ellipses=ELLIPSIS),
    }


def rules() -> dict[str, Column]:
    """Whether each rule fails, by the columns of counts(); ratios are compared in integers."""
    n, lines, size, solid = F.col("words.n"), F.col("lines.n"), F.col("size"), F.col("solid")
    many, long = n >= MIN_WORDS, lines >= MIN_LINES
    return {
        "few_words": n < FEW_WORDS,
        "symbols": F.col("symbols") * 100 > size * 6,
        "capitals": (n >= 10) & (F.col("capitals") * 100 > size * 30),
        "no_letters": many & (F.col("words.letters") * 5 < n * 4),
        "word_length": many & ((solid < n * 2) | (solid > n * 15)),
        "long_words": size > n * 40,
        "same_words": many & (F.col("words.distinct") * 5 < n),
        "same_lines": long & (F.col("lines.distinct") * 2 < lines),
        "bullets": long & (F.col("lines.bullets") * 10 > lines * 9),
        "ellipses": long & (F.col("lines.ellipses") * 10 > lines * 3),
        "filler": F.col("filler"),
    }


def _moments() -> list[Column]:
    """Over hosts of n documents of which x fail."""
    n, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    return [F.count("*").cast("double").alias("k"), F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx")]


def _prior() -> list[Column]:
    """The beta prior's a and b by moments. A host's rate varies by what sets hosts apart and by chance, the more the
    fewer documents it has. The correlation of documents of one host, rho, is what the spread of the rates, weighted by
    documents, has beyond chance; the prior is worth 1 / rho - 1 documents."""
    m = F.col("x") / F.col("n")
    spread = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    free = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    told = (F.col("k") > 1) & (F.col("x") > 0) & (F.col("x") < F.col("n")) & (free > 0)
    rho = (spread / F.when(told, m * (1 - m)) - (F.col("k") - 1)) / F.when(told, free)
    worth = F.when(~told, PRIOR).when(rho * (MOST_PRIOR + 1) <= 1, MOST_PRIOR).otherwise(F.greatest(1 / F.when(rho > 0, rho) - 1, F.lit(0.0)))
    return [(m * worth).alias("a"), ((1 - m) * worth).alias("b")]


def verdicts(docs: DataFrame, host: str | None = None, blocked: float = BLOCKED, trusted: float = TRUSTED) -> DataFrame:
    """(doc_id, host, failed, host_docs, host_failed, host_rate, verdict, keep) of every row of docs.

    host names the column of the host or of a URL that has it: url unless given or, if there is none, source. failed counts the rules that a document fails, host_failed the host's documents that fail any. The rate is
    (host_failed + a) / (host_docs + a + b). verdict is blocked, watched or trusted; keep is false for all documents of
    a blocked host, else for those that fail a rule, of which a trusted host is forgiven one. A document that fails
    none, of a host that is not blocked, always stays.

    The prior is fitted by the moments of all hosts (_prior). The null host is a host, null ids stay null, repeated rows count each; a null text fails like an empty one. A
    column of another name is not read. An empty table gives no rows.
    """
    failed = sum((F.when(r, 1).otherwise(0) for r in rules().values()), F.lit(0))
    host = host or next((c for c in docs.columns if c.lower() == "url"), "source")
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of(F.col(host)).alias("host"), *(c.alias(k) for k, c in counts(F.col("text")).items()))
    judged = written(judged.select("doc_id", "host", failed.cast("long").alias("failed")), "judged")
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.count(F.when(F.col("failed") > 0, 1)).alias("host_failed"))
    hosts = written(hosts, "hosts")
    prior = hosts.agg(*_moments()).select(*_prior())
    shrunk = F.round((F.col("host_failed") + F.col("a")) / (F.col("host_docs") + F.col("a") + F.col("b")), 6)
    hosts = hosts.crossJoin(F.broadcast(prior)).select(F.col("host").alias("h"), "host_docs", "host_failed", shrunk.alias("host_rate"))  # the prior is one row
    verdict = F.when(F.col("host_rate") >= blocked, "blocked").when(F.col("host_rate") < trusted, "trusted").otherwise("watched")
    out = judged.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("verdict", verdict)
    keep = (F.col("verdict") != "blocked") & (F.col("failed") <= F.when(F.col("verdict") == "trusted", 1).otherwise(0))
    return out.withColumn("keep", keep)


def kept(docs: DataFrame, host: str | None = None) -> DataFrame:
    """The verdicts of the documents that stay."""
    return verdicts(docs, host).where("keep").drop("keep")


ORACLE = f"""
with d as (select doc_id, coalesce(nullif(lower(regexp_extract(source, '{HOST}', 1)), ''), source) host, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w, string_split(t, chr(10)) l, length(t) c,
  length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) s from d),
j as (select doc_id, host, ((len(w) < {FEW_WORDS})::int + (len(regexp_extract_all(t, '{SYMBOLS}')) * 100 > c * 6)::int
  + (len(w) >= 10 and len(regexp_extract_all(t, '{CAPITALS}')) * 100 > c * 30)::int
  + (len(w) >= {MIN_WORDS} and len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) * 5 < len(w) * 4)::int
  + (len(w) >= {MIN_WORDS} and (s < len(w) * 2 or s > len(w) * 15))::int + (c > len(w) * 40)::int
  + (len(w) >= {MIN_WORDS} and len(list_distinct(w)) * 5 < len(w))::int
  + (len(l) >= {MIN_LINES} and len(list_distinct(l)) * 2 < len(l))::int
  + (len(l) >= {MIN_LINES} and len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) * 10 > len(l) * 9)::int
  + (len(l) >= {MIN_LINES} and len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) * 10 > len(l) * 3)::int
  + regexp_matches(t, '{FILLER}')::int)::bigint failed from w),
h as (select host, count(*)::double n, (count(*) filter (failed > 0))::double x from j group by host),
p as (select count(*)::double k, sum(n) n, sum(x) x, sum(n * n) nn, sum(x * x / n) xx from h),
q as (select *, x / n m, xx - x * x / n spread, n - nn / n - (k - 1) free, k > 1 and x > 0 and x < n and n - nn / n - (k - 1) > 0 told from p),
r as (select *, case when told then (spread / (m * (1 - m)) - (k - 1)) / free end rho from q),
v as (select m, case when not told then {PRIOR} when rho * ({MOST_PRIOR} + 1) <= 1 then {MOST_PRIOR} else greatest(1 / rho - 1, 0.0) end k from r),
z as (select host, n::bigint host_docs, x::bigint host_failed, round((x + m * k) / (n + m * k + (1 - m) * k), 6) host_rate from h, v),
o as (select *, case when host_rate >= {BLOCKED} then 'blocked' when host_rate < {TRUSTED} then 'trusted' else 'watched' end verdict from z)
select j.doc_id, j.host, failed, host_docs, host_failed, host_rate, verdict from j join o on j.host is not distinct from o.host
where verdict <> 'blocked' and failed <= case when verdict = 'trusted' then 1 else 0 end
"""
