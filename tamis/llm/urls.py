"""URL filter: rules for hosts and paths first, else a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset(LOWER + "0123456789")

#: Stems of words of which one rejects an address, and stems of which several different ones do. Chosen for this filter.
STRICT_STEMS = ("adultx", "bestiality", "blackjack", "camgirl", "camsex", "cardsharing", "casino", "cialis", "crackedsoftware", "escort", "fakeid", "gambling", "gangbang", "hentai", "hookup", "incest", "jackpot", "malware", "milf", "onlinecasino", "phishing", "pokies", "porn", "porno", "pornography", "sexcam", "sexchat", "slotmachine", "spamfarm", "sportsbetting", "viagra", "voyeur", "warez", "webcamsex", "xxx")
SOFT_STEMS = ("ad", "adult", "banner", "bet", "bingo", "bonus", "cash", "cheap", "clearance", "click", "coupon", "crack", "credit", "deal", "discount", "download", "earn", "erotic", "farm", "forex", "free", "fun", "gift", "giveaway", "hack", "hot", "keygen", "kinky", "loan", "lottery", "lucky", "money", "naked", "nude", "offer", "payday", "pharma", "pharmacy", "pill", "poker", "popup", "prize", "profit", "proxy", "rich", "roulette", "serial", "sex", "sexy", "slot", "spam", "strip", "sweepstake", "torrent", "track", "tracker", "unlock", "wager", "win", "winner")
#: A term's weight: strict ones reach the limit alone, soft ones in twos.
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2, 1, 2
#: Stems whose words are written with a hyphen too.
PARTED = {"adultx": "adult-x", "spamfarm": "spam-farm", "slotmachine": "slot-machine", "onlinecasino": "online-casino", "sportsbetting": "sports-betting", "fakeid": "fake-id", "sexcam": "sex-cam", "sexchat": "sex-chat"}


def forms(stem: str) -> set[str]:
    """A stem, its plural, and what is written with a hyphen or with x, 24 or online after it."""
    plural = f"{stem}s" if stem[-1] not in "sxy" else stem
    return {stem, plural, PARTED.get(stem, stem), f"{stem}x", f"{stem}24", f"{stem}online"}


STRICT = tuple(sorted({f for stem in STRICT_STEMS for f in forms(stem)}))
SOFT = tuple(sorted({f for stem in SOFT_STEMS for f in forms(stem)} - set(STRICT)))


def vocabulary(lines: Iterable[str]) -> dict[str, int]:
    """{term: weight} from lines ``term``, tab, weight (a term alone is strict); ``#`` starts a comment. For lists of any size, from a file."""
    out: dict[str, int] = {}
    for line in lines:
        term, _, weight = line.split("#")[0].strip().translate(str.maketrans(UPPER, LOWER)).partition("\t")
        if term:
            out[term.strip()] = int(weight or STRICT_WEIGHT)
    return out


Rule = tuple[str, str, str]  # host, path, verdict


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host_col: Column, path_col: Column, answer: int | None = None) -> Column:
    """The longest rule that fits (host and path together), as ``host/path`` or its verdict; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        out = F.when(fits, F.lit(verdict if answer == 2 else h + p)).otherwise(out)
    return out


def default_terms() -> dict[str, int]:
    return dict.fromkeys(SOFT, SOFT_WEIGHT) | dict.fromkeys(STRICT, STRICT_WEIGHT)


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(text: str, terms: ahocorasick.Automaton) -> dict[str, int]:
    """The different terms, with their weights, that stand in the text with no letter or digit right before or after."""
    out: dict[str, int] = {}
    for end, (term, weight) in terms.iter(text):
        start = end + 1 - len(term)
        if (start == 0 or text[start - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
            out[term] = weight
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", terms: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft) for every row.

    Where no rule fits, the verdict is ``block`` if the weights of the different terms found in the
    whole address (A-Z lower-cased) add up to ``limit``: one strict term (of that weight) or
    several soft ones; else ``allow``. A null address has no
    terms and is allowed; one without ``://`` is searched as it stands. Ties between rules of one
    length go to the later one in alphabetic order. Repeated rows each get their answer; other
    columns aren't read; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()), T.StructField("weight", T.LongType())])
    wanted = default_terms() if terms is None else terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(wanted) if wanted else None
        low = str.maketrans(UPPER, LOWER)
        for batch in batches:
            found = [list(hits((u or "").translate(low), known).values()) if known else [] for u in batch.column(1).to_pylist()]
            strict = [sum(w >= limit for w in f) for f in found]
            counts = (strict, [len(f) - s for f, s in zip(found, strict, strict=True)], list(map(sum, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts)], names=schema.names)

    counted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, schema)
    counted = counted.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    method = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return counted.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        longest_rule(rules, F.col("host"), F.col("path")).alias("rule"),
        F.coalesce(longest_rule(rules, F.col("host"), F.col("path"), 2), method).alias("verdict"),
        "n_strict",
        "n_soft",
    )


def sql(rules: list[Rule], strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, least: int = 2) -> str:
    """The same rows in DuckDB's SQL, one regular expression a term."""
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    count = lambda terms: " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(h, p, v)}'" for h, p, v in ordered) + " END"
    return f"""
WITH p AS (SELECT page_id, {low} AS u, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT page_id, host, path, {count(strict)} AS n_strict, {count(soft)} AS n_soft FROM p)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
       coalesce({case(lambda h, p, v: v)}, CASE WHEN n_strict > 0 OR n_soft >= {least} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft FROM c
"""
