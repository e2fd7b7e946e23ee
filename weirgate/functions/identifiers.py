"""Partner identifiers as column expressions: normal forms, hashes, item counts and routes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped, and the partner names of identifier types.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"
CONSENT = ("GRANTED", "DENIED")
PREFERRED = ("email", "phone_e164", "mobile_advertising_id")
IDENTIFIERS = "array<struct<type:string,value:string>>"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def lowered(c: Column) -> Column:
    return F.lower(stripped(c))


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def hashed(c: Column, normal: Column | None = None) -> Column:
    """A hex digest stays, in lower case; anything else is hashed in its normal form."""
    plain = stripped(c)
    return F.when(is_sha256(plain), F.lower(plain)).otherwise(F.sha2(plain if normal is None else normal, 256))


def email(c: Column) -> Column:
    """Lower case without white space; without the dots of the local part where the mail host ignores them."""
    whole = F.lower(F.regexp_replace(c, SPACE, ""))
    local = F.substring_index(whole, "@", 1)
    domain = F.substring(whole, F.length(local) + 2, F.length(whole))
    return F.when(domain.isin("gmail.com", "googlemail.com"), F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@"), domain)).otherwise(whole)


def hashed_email(c: Column) -> Column:
    return hashed(c, email(stripped(c)))


def hashed_name(c: Column) -> Column:
    return F.sha2(lowered(c), 256)


def address(**parts: Column) -> Column:
    """A struct of address fields: given_name and family_name hashed in lower case, the others stripped; blank ones are null."""
    blank = lambda c: F.when(stripped(c) != "", c)
    return F.struct(*[(hashed_name(blank(c)) if n in ("given_name", "family_name") else stripped(blank(c))).alias(n) for n, c in parts.items()])


def consent(c: Column) -> Column:
    """The status in upper case, or null where it is none."""
    value = F.upper(stripped(c))
    return F.when(value.isin(*CONSENT), value)


def epoch_seconds(c: Column) -> Column:
    """Seconds of an RFC 3339 text with a zone; null without one."""
    zoned = c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.unix_timestamp(F.to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))))


def parsed(identifiers_json: Column) -> Column:
    """Non-blank identifiers of a JSON array."""
    items = F.from_json(identifiers_json, IDENTIFIERS)
    return F.filter(F.coalesce(items, F.array().cast(IDENTIFIERS)), lambda x: x["value"].isNotNull() & (stripped(x["value"]) != ""))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["type"] == kind


def audience_items(identifiers: Column, types: Sequence[str]) -> Column:
    """Request items of an audience record: one if each type has one value, else one per value."""
    sizes = F.array(*[F.size(F.filter(identifiers, _is(t))) for t in types])
    used = F.filter(sizes, lambda n: n > 0)
    total = F.aggregate(used, F.lit(0), lambda a, n: a + n)
    return F.when(F.size(used) == 0, 0).when(F.forall(used, lambda n: n == 1), 1).otherwise(total).cast("long")


def preferred_type(identifiers: Column, order: Sequence[str] = PREFERRED) -> Column:
    """The first type of the order that has a value."""
    return F.coalesce(*[F.when(F.exists(identifiers, _is(t)), F.lit(t)) for t in order])


def preferred_items(identifiers: Column, order: Sequence[str] = PREFERRED) -> Column:
    """Number of values of the preferred type; 0 without one."""
    best = preferred_type(identifiers, order)
    return F.coalesce(F.size(F.filter(identifiers, lambda x: x["type"] == best)), F.lit(0)).cast("long")


def routed(name: Column, routes: Mapping[str, str], default: str | None) -> Column:
    """Where events of a name go."""
    pairs = [F.lit(x) for k, v in routes.items() for x in (k, v.strip())]
    found = F.create_map(*pairs)[stripped(name)] if pairs else F.lit(None).cast("string")
    return F.coalesce(F.when(found != "", found), F.lit(default))


def normalized_targets(c: Column) -> Column:
    return F.when(stripped(c) != "", stripped(c))
