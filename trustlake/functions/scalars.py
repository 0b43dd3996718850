"""Column functions of normalization, all built from Spark's own expressions.

In each docstring, what a null gives is said; text is compared trimmed and lower-cased where "any case" stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def number(c: Column, default: float = 0.0) -> Column:
    """As a double; what is no number (null too) becomes the default."""
    v = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(float(default)))


def low(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def parse_timestamp(c: Column) -> Column:
    """To whole seconds; bad or null gives null."""
    return F.date_trunc("second", F.try_to_timestamp(c.cast("string")))


def known(c: Column) -> Column:
    """Trimmed lower case; null gives 'unknown'."""
    return F.coalesce(low(c), F.lit("unknown"))


def to_bool01(c: Column) -> Column:
    """1 for numbers of at least 1 and for 1, true, t, yes, y in any case; else (null too) 0."""
    s = low(c)
    return F.when(s.isin("1", "true", "t", "yes", "y") | (s.try_cast("double") >= 1), 1).otherwise(0)


def posture(c: Column) -> Column:
    """A compliance value as a score: [0, 1] stays, (1, 100] is a percentage, other numbers .5; words give .9 or .2; else .5."""
    v, s = c.cast("string").try_cast("double"), low(c)
    return (
        F.when(v.between(0, 1), v).when((v > 1) & (v <= 100), v / 100).when(v.isNotNull(), F.lit(0.5))
        .when(s.isin("compliant", "true", "1", "yes"), F.lit(0.9)).when(s.isin("noncompliant", "non-compliant", "false", "0", "no"), F.lit(0.2)).otherwise(F.lit(0.5))
    )


def stable_hash(*parts: Column, modulus: int = 2**31 - 1) -> Column:
    """The first 12 hex digits of the SHA-256 of the parts joined by '|', modulo modulus; a null part counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 12), 16, 10).cast("long") % F.lit(modulus)


def token_id(principal: Column, session: Column) -> Column:
    return F.concat(F.lit("tok_"), F.lpad(stable_hash(principal, session, modulus=10**10).cast("string"), 10, "0"))


def workload_id(principal: Column, cloud: Column) -> Column:
    return F.concat(F.lit("wk_"), F.lpad(stable_hash(principal, cloud, modulus=10**8).cast("string"), 8, "0"))


def synthetic_ipv4(*parts: Column) -> Column:
    """10.a.b.c with octets from 1 to 254, from the hash modulo 256 cubed."""
    h = stable_hash(*parts, modulus=256**3)
    octet = lambda shift: (1 + F.shiftright(h, shift) % 256 % 254).cast("string")
    return F.concat_ws(".", F.lit("10"), octet(16), octet(8), octet(0))


def derived_latency(ts: Column, nbytes: Column, principal: Column, action: Column) -> Column:
    """Milliseconds for logs without a latency: grows with the bytes, with a stable jitter below 50.  Bytes enter the hash with two
    decimals, as engines print doubles differently."""
    jitter = stable_hash(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.format_string("%.2f", nbytes), principal, action, modulus=5000) / 100
    return 12 * F.log1p(nbytes) + jitter


def scope_width(c: Column) -> Column:
    """Number of scopes: parts at the first separator that occurs of | , ; blank; 0 for null, empty, none, nan, null."""
    s = F.trim(c.cast("string"))
    parts = lambda sep: F.size(F.filter(F.split(s, sep), lambda x: F.trim(x) != ""))
    some = F.when(s.contains("|"), parts("\\|")).when(s.contains(","), parts(",")).when(s.contains(";"), parts(";")).when(s.contains(" "), parts(" ")).otherwise(1)
    return F.when(c.isNull() | F.lower(s).isin("", "none", "nan", "null"), 0).otherwise(some)


def is_privileged(role: Column) -> Column:
    return F.when(F.lower(role).rlike("admin|owner|root|superuser|priv|security|sudo"), 1).otherwise(0)


def sensitivity_score(c: Column) -> Column:
    s = low(c)
    return F.when(s.isin("critical", "secret"), 1.0).when(s == "high", 0.75).when(s.isin("medium", "med"), 0.45).when(s == "low", 0.15).otherwise(0.25)


def parse_tags(c: Column) -> Column:
    """Tags of "['a', 'b']", a|b, a;b or a,b as an array; null gives an empty one."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\[\\]'\"]", "")
    return F.filter(F.transform(F.split(bare, "[;|,]"), lambda x: F.trim(x)), lambda x: x != "")


def mixed_timestamp(c: Column) -> Column:
    """ISO text, else epoch milliseconds above 10**12, else epoch seconds; bad gives null."""
    s, v = c.cast("string"), c.cast("string").try_cast("double")
    epoch = F.when(v > 1e12, F.timestamp_millis(v.cast("long"))).otherwise(F.timestamp_seconds(v))
    return F.when(v.isNotNull(), epoch).otherwise(F.try_to_timestamp(s))


def unit_hash(c: Column, seed: int = 42) -> Column:
    """A stable draw from [0, 1]: the first 8 hex digits of MD5 of 'seed:text', over their largest value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def to_decision(c: Column) -> Column:
    s = low(c)
    return (
        F.when(s.isin("allow", "permit"), "allow").when(s.isin("stepup", "step-up", "step_up", "mfa"), "stepup").when(s == "restrict", "restrict").when(s.isin("deny", "block"), "deny").otherwise("allow")
    )


def severity(c: Column) -> Column:
    s = low(c)
    return F.when(s == "stepup", 1).when(s == "restrict", 2).when(s.isin("deny", "block"), 3).otherwise(0)


def sensitivity_level(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.isin("LOW", "MED", "HIGH", "CRITICAL"), s).otherwise("LOW")


def role_level(c: Column) -> Column:
    s = low(c)
    return F.when(s.isin("admin", "service", "engineer", "employee", "contractor"), s).otherwise("employee")


def tags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order; a null condition does not hold."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
