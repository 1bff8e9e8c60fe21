"""Column functions on labels, identifiers, licences and measurements."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that a label may have. Fixed values.
LEVELS = (3, 4, 5, 6, 7)
#: Canonical licences and the versions accepted of each. Fixed values.
LICENCE_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: Hosts that each provider's files may come from (with a leading dot: its subdomains); an index of others' files has no list. Fixed values.
PROVIDER_HOSTS = {"wikimedia": ("upload.wikimedia.org",), "open-images": ("storage.googleapis.com", ".staticflickr.com"), "nutrition5k": ("storage.googleapis.com",), "openverse": None}


def valid_level(value: Column) -> Column:
    """An integer level 3..7, given as any number; null for anything else, non-integral ones too."""
    number = value.cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number)) & number.between(LEVELS[0], LEVELS[-1])
    return F.when(ok, number.cast("int"))


def event_id(provider: Column, source_id: Column) -> Column:
    """``RW_<provider>_<20 hex digits>`` of the SHA-256 of provider, a zero byte and the source's id."""
    digest = F.sha2(F.concat(provider, F.lit("\0"), source_id), 256)
    return F.concat(F.lit("RW_"), F.substring(provider, 1, 24), F.lit("_"), F.substring(digest, 1, 20))


def safe_identifier(value: Column, fallback: str, length: int = 64) -> Column:
    """Runs of characters other than ``[A-Za-z0-9._-]`` become ``-``; ``-._`` go from the ends; the fallback if nothing is left."""
    made = F.btrim(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    made = F.substring(made, 1, length)
    return F.coalesce(F.when(made != "", made), F.lit(fallback))


def unit_hash(seed: str, key: Column) -> Column:
    """The first 16 hex digits of SHA-256 of ``seed|key``, as a number in [0, 1)."""
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256), 1, 16)
    return F.conv(hexed, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def stable_seed(*parts: Column) -> Column:
    """31 bits from the SHA-256 of the parts joined by ``::``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits in which two hashes of 16 hex digits differ; compared as halves, since the whole overflows a long."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def licence(name: Column, url: Column, creator: Column) -> Column:
    """struct(allowed, canonical, reason): CC0 and CC BY or BY-SA of an accepted version, with an address that says so and a creator."""
    n, u = F.upper(F.btrim(F.coalesce(name, F.lit("")))), F.lower(F.coalesce(url, F.lit("")))
    kind = F.regexp_extract(n, r"^CC (BY(?:-SA)?) (\d\.\d)$", 1)
    version = F.regexp_extract(n, r"^CC (BY(?:-SA)?) (\d\.\d)$", 2)
    zero = n.isin("CC0", "CC0 1.0")
    answer = lambda ok, canon, why: F.struct(F.lit(ok).alias("allowed"), canon.alias("canonical"), F.lit(why).alias("reason"))
    none = F.lit(None).cast("string")
    return (
        F.when(F.btrim(F.coalesce(creator, F.lit(""))) == "", answer(False, none, "missing_creator"))
        .when(zero & u.contains("/publicdomain/zero/1.0"), answer(True, F.lit("CC0 1.0"), "ok"))
        .when(zero, answer(False, none, "licence_url_mismatch"))
        .when((kind == "") | ~version.isin(*LICENCE_VERSIONS), answer(False, none, "licence_not_allowed"))
        .when(u.contains(F.concat(F.lit("/licenses/"), F.lower(kind), F.lit("/"), version)), answer(True, F.concat(F.lit("CC "), kind, F.lit(" "), version), "ok"))
        .otherwise(answer(False, none, "licence_url_mismatch"))
    )


def licence_from_url(url: Column) -> Column:
    """``CC BY <version>`` from an address with ``/licenses/by/<version>``; null for others."""
    version = F.regexp_extract(url, r"/licenses/by/([^/]+)", 1)
    return F.when(version != "", F.concat(F.lit("CC BY "), version))


def safe_download(url: Column, provider: Column) -> Column:
    """https, no user or password in the address, and a host of the provider's, in any case; false for null and unknown providers."""
    authority = F.regexp_extract(url, r"(?i)^https://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, "([^@]*)$", 1), r":\d*$", ""))
    fits = F.lit(False)
    for name, hosts in PROVIDER_HOSTS.items():
        own = F.lit(hosts is None)
        for h in hosts or ():
            own = own | (host.endswith(h) if h.startswith(".") else host == h)
        fits = fits | ((provider == name) & own)
    return F.coalesce((host != "") & ~F.regexp_extract(authority, "^(.*)@", 1).rlike("[^:]") & fits, F.lit(False))


def lenient_bool(value: Column) -> Column:
    """true, yes, y and 1 in any case, trimmed, are true; all else, null too, false."""
    return F.coalesce(F.lower(F.btrim(value.cast("string"))).isin("true", "yes", "y", "1"), F.lit(False))


def strict_number(value: Column) -> Column:
    """A JSON number as a double; null for JSON strings, booleans and anything else."""
    return F.when(F.btrim(value).rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), value.try_cast("double"))


def longest_object(text: str | None) -> str | None:
    """A text that begins with a brace and breaks off, cut at its last comma from which on a closing brace makes it an object.

    One scan finds the commas between the object's own members; since a cut at any of them parses
    if a later one does, the last that parses is found by halving.
    """
    if text is None:
        return None
    ends, depth, quoted, at = [], 0, False, 0
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == "," and depth == 1:
            ends.append(at)
        at += 1
    ends.append(len(text))

    def parses(k: int) -> bool:
        try:
            json.loads(text[: ends[k]] + "}", parse_constant=_refuse)
        except (ValueError, RecursionError):
            return False
        return True

    low, high = -1, len(ends) - 1  # low parses, or is before the first
    while low < high:
        middle = (low + high + 1) // 2
        if parses(middle):
            low = middle
        else:
            high = middle - 1
    return None if low < 0 else text[: ends[low]] + "}"


def _refuse(name: str) -> None:
    raise ValueError(name)


def json_from_text(text: Column) -> Column:
    """The object between the first and the last brace of a text that may be fenced; if it doesn't parse, cut at its last comma that makes it parse.

    Whole objects are found in the JVM; only broken ones go to Python, in Arrow batches.
    """
    plain = F.regexp_replace(text, r"```(?:json)?", "")
    body, opened = F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.regexp_extract(plain, r"(?s)\{.*", 0)
    parses = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    cut = F.pandas_udf(lambda many: many.map(longest_object, na_action="ignore"), "string")
    broken = cut(F.when((opened != "") & ~parses(body), opened))
    return F.when(parses(body), body).when(parses(broken), broken)


def weak_level(flow: Column, smooth: Column, particles: Column, pieces: Column, mm: Column) -> Column:
    """The rule ladder from observations to a level: the first rung that fits."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(flow), 3)
        .when(yes(smooth) & ~yes(particles) & ~yes(pieces), 4)
        .when(yes(particles) & F.coalesce(mm <= 4, F.lit(False)), 5)
        .when(yes(pieces) & F.coalesce(mm.between(10, 20), F.lit(False)), 6)
        .otherwise(7)
    )


def clamp_confidence(value: Column, top: float = 0.95) -> Column:
    """Into [0, top]; null and NaN are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(top), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))))


def normalise_prompt(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters, digits and CJK ideographs as one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]+", " "))


def iso_datetime(text: Column) -> Column:
    """Whether a text is an ISO date and time with a ``T`` and an offset (``Z`` or +hh:mm)."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def keyword_family(text: Column, families: dict[str, list[str]]) -> Column:
    """The one family whose words (whole, with an optional plural s) occur; ``uninformative`` for none, ``ambiguous`` for several."""
    edge = r"[^\p{L}\p{N}_]"  # letters of any script make words
    hit = F.filter(F.array(*(F.when(text.rlike(rf"(?i)(^|{edge})({'|'.join(words)})s?($|{edge})"), F.lit(name)) for name, words in families.items())), lambda x: x.isNotNull())
    return F.when(F.size(hit) == 1, F.get(hit, F.lit(0))).when(F.size(hit) == 0, "uninformative").otherwise("ambiguous")


def structural_family(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The family of the first (part, family) whose part occurs in the lower-cased text."""
    out = F.lit(other)
    for part, name in reversed(rules):
        out = F.when(F.lower(text).contains(part), name).otherwise(out)
    return out


def flow_level(remaining: Column, flowed: Column) -> Column:
    """Under 1 mL left L0, under 4 L1, under 8 L2; else L4 if no more than 0.2 flowed, else L3."""
    return F.when(remaining < 1, "L0").when(remaining < 4, "L1").when(remaining < 8, "L2").when(flowed <= 0.20, "L4").otherwise("L3")


def boundary_distance(remaining: Column) -> Column:
    """The distance to the nearest band edge (1, 4 or 8 mL)."""
    return F.array_min(F.transform(F.array(F.lit(1.0), F.lit(4.0), F.lit(8.0)), lambda b: F.abs(remaining - b)))


def flow_reading(text: Column) -> Column:
    """struct(value, error): a number with an optional unit and ≈; skip words give null without an error."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"ml|cc|≈|~", ""))
    skip = bare.isin("", "-", "na", "n/a", "skip", "none")
    number = F.when(~skip, bare.try_cast("double"))
    return F.struct(number.alias("value"), (~skip & number.isNull()).alias("error"))


def outcome(reading: Column, low: float = 8.0, high: float = 10.0) -> Column:
    """``pass`` within [low, high], else ``fail``; a missing reading fails."""
    return F.when(F.coalesce(reading.between(low, high), F.lit(False)), "pass").otherwise("fail")


def printed_tolerance(printed: Column) -> Column:
    """Half a unit of the last decimal that a printed number shows."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -F.length(F.coalesce(F.split_part(printed, F.lit("."), F.lit(2)), F.lit(""))).cast("double"))


def number_or_null(text: Column) -> Column:
    """A number, or null for N/A, dashes and anything else."""
    return F.btrim(F.regexp_replace(text, "[,%]", "")).try_cast("double")


def percent(part: Column, whole: Column) -> Column:
    """part / whole in per cent; null where the whole is zero or null."""
    return F.try_divide(part * 100.0, whole)


def is_unverified(record_present: Column, status: Column, synthetic: Column) -> Column:
    """A record whose status isn't ``verified`` (case and spaces aside), unless synthetic; no record isn't unverified."""
    fine = F.coalesce(F.lower(F.btrim(status)) == "verified", F.lit(False))
    return record_present & ~synthetic & ~fine


def is_sharealike(name: Column) -> Column:
    """A licence that begins with BY-SA or CC BY-SA once case, underscores and spaces are made alike."""
    return F.coalesce(F.regexp_replace(F.upper(F.btrim(name)), "[_ ]+", "-").rlike("^(CC-)?BY-SA"), F.lit(False))


def softmax(values: Column) -> Column:
    """Of an array of doubles, less its maximum first."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ordinal_targets(level: Column, classes: int = 5, smoothing: float = 0.0) -> Column:
    """1 where the level is over k, for k = 0..classes-2; drawn towards a half by ``smoothing``."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 2)), lambda k: F.when(level > k, F.lit(1.0)).otherwise(F.lit(0.0)) * (1 - smoothing) + smoothing / 2)


def provider_of(event: Column) -> Column:
    """The provider in an ``RW_<provider>_...`` identifier; ``?`` for others."""
    return F.when(event.startswith("RW_"), F.split_part(event, F.lit("_"), F.lit(2))).otherwise("?")


def value_range(value: Column, digits: int = 3) -> Column:
    """An aggregate: the finite values' least and greatest as ``low-high``; ``n/a`` if there are none."""
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.coalesce(F.concat(F.format_string(f"%.{digits}f", F.min(finite)), F.lit("-"), F.format_string(f"%.{digits}f", F.max(finite))), F.lit("n/a"))


def on_host(path: Column, inside: str, root: str) -> Column:
    """A container's path as the host has it: the first ``inside`` becomes ``root``."""
    at = F.instr(path, inside)
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(root), F.substring(path, at + len(inside), F.length(path)))).otherwise(path)


def utc_stamp(at: Column | None = None) -> Column:
    """``2024-01-02T03:04:05Z`` of a timestamp, or of now."""
    return F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
