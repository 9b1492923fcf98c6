"""One surviving record per duplicate group, chosen field by field.

The fields of the members are unpivoted to long rows and unusable values are dropped. Each value votes with the trust
in its source times a decay by its age; the votes are summed per normalised value, the value with the largest vote
wins its (group, field), shown as its best member writes it, and the winners are pivoted back to one record per group.
All of it is aggregation with map-side combination; nothing is collected per group, so a group may hold any share of
the rows.

How steep trust and decay are decides what a sum can do. ``votes="sum"`` halves trust per rank and decays with a
half-life, so agreement counts. ``votes="rank"`` is the limit of endless steepness: a vote of a better rank outweighs
any number of worse ones, and a later change any number of earlier ones, so sums are compared by their leading term,
the best member's (trust rank, change date); of equal terms the smallest id leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.skew import blank_to_null

FIELDS = ["city", "street", "postal_code", "tax_number", "email", "phone"]
#: Half-life in days of a vote, and the trust halves with each rank.
HALF_LIFE_DAYS = 730.0
# Texts that stand in for a missing value, in lower case, without white space and closing punctuation.
STAND_INS = [
    "0", "n/a", "#n/a", "n.a", "na", "k.a", "ka", "s.o", "so", "none", "null", "nil", "nan", "missing", "leer", "unknown",
    "unbekannt", "unbek", "tbd", "tbc", "tba", "xxx", "xxxxx", "xx", "x", "xxxx", "test", "dummy", "keineangabe", "nichtgepflegt",
    "notavailable", "notapplicable", "notmaintained", "tobesupplied", "tobedefined", "toberequested", "seemasterfile", "sameasabove",
    "siehe oben", "sieheoben", "pending", "appliedfor", "beantragt", "empty", "blank", "offen", "folgt", "ohne",
]
# Names of the fields typed where the value belongs, in the same form.
LABELS = [
    "city", "cityname", "ort", "stadt", "town", "plz", "zip", "zipcode", "postcode", "postalcode", "street", "streetname",
    "street+no", "strasse", "straße", "str", "address", "adresse", "nostreet", "taxno", "taxnumber", "ustid", "vat", "vatid",
    "email", "e-mail", "mail", "noemail", "noe-mail", "mailto", "www", "info(at)", "phone", "tel", "telefon", "nophone", "fax",
]


def usable(field: Column, value: Column) -> Column:
    """Whether ``value`` can be a value of the field: not blank, no stand-in, no field name, of a possible form."""
    text = F.lower(F.regexp_replace(value, r"[\s ]+", ""))
    bare = F.regexp_replace(text, r"[.:;,!]+$", "")
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    digits = F.regexp_replace(value, r"[^0-9]", "")
    varied = ~digits.rlike(r"^(\d)\1*$")
    form = (
        F.when(field == "postal_code", (F.length(digits) >= 3) & (F.length(text) <= 10) & varied)
        .when(field == "tax_number", (F.length(digits) >= 5) & varied & ~text.rlike(r"^xx"))
        .when(field == "email", text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$"))
        .when(field == "phone", (F.length(digits) >= 7) & varied & (letters == 0))
        .when(field == "street", (letters >= 3) & (digits != ""))
        .otherwise(letters >= 2)
    )
    words = [*STAND_INS, *LABELS]
    return F.coalesce(blank_to_null(value).isNotNull() & ~bare.isin(words) & (bare != "") & form, F.lit(False))


def normalised(field: Column, value: Column) -> Column:
    """The value without case, spacing and separators, so that equal values written differently vote together."""
    text = F.lower(F.regexp_replace(value, r"[\s ]+", " "))
    return F.when(field.isin("postal_code", "tax_number"), F.regexp_replace(text, r"[^a-z0-9]", "")).when(
        field == "phone", F.regexp_replace(F.regexp_replace(text, r"[^0-9]", ""), r"^00", "")
    ).when(field == "email", F.regexp_replace(text, r"[<> ]", "")).otherwise(F.trim(text))


def member_values(groups: DataFrame, vendors: DataFrame, sources: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Long rows (group_id, legacy_vendor_id, field_name, value, trust_rank, changed_at) of all usable values.

    Repeated members and repeated deliveries of a vendor count once (the latest loaded_at). Members without a vendor
    record give nothing. Sources that are NULL or not listed come after all listed ones.
    """
    members = groups.select("group_id", "legacy_vendor_id").where("group_id is not null and legacy_vendor_id is not null").distinct()
    listed = vendors.join(members.select("legacy_vendor_id").distinct(), "legacy_vendor_id", "left_semi")
    kept = ["source_system", "changed_at", *fields]
    # Ties of loaded_at are broken by the values themselves, so the order of rows never matters.
    latest = (
        listed.groupBy("legacy_vendor_id")
        .agg(F.max(F.struct("loaded_at", *kept)).alias("r"))
        .select("legacy_vendor_id", *(F.col(f"r.{c}").alias(c) for c in kept))
    )
    ranks = sources.groupBy("source_system").agg(F.min("trust_rank").alias("trust_rank"))
    # source_systems is a list of systems kept by hand; a join lets the optimiser decide by its size.
    joined = members.join(latest, "legacy_vendor_id").join(ranks, "source_system", "left")
    rank = F.coalesce(F.col("trust_rank").cast("int"), F.lit(2**31 - 1)).alias("trust_rank")
    long = joined.select("group_id", "legacy_vendor_id", rank, "changed_at", *fields).unpivot(
        ["group_id", "legacy_vendor_id", "trust_rank", "changed_at"], fields, "field_name", "value"
    )
    return long.where(usable(F.col("field_name"), F.col("value")))


def survivors(values: DataFrame, votes: str = "rank", newest: DataFrame | None = None) -> DataFrame:
    """(group_id, field_name, value, legacy_vendor_id, vote) from the long rows of :func:`member_values`.

    The votes of all members with the same normalised value are summed; the winner is the value with the largest sum
    (see above how ``votes`` compares them; of equal sums the best single member leads). Groups without a usable value
    have no row for that field. Ages count from the date in ``newest``, one row with the column newest, or else from
    the newest change of the values, so that a later run gives the same votes.
    """
    # A NULL change date is older than any date.
    age = (-F.coalesce(F.unix_micros("changed_at"), F.lit(-(2**62)))).alias("age")
    best = F.struct("trust_rank", age, "legacy_vendor_id", "value")
    by = ["group_id", "field_name"]
    if newest is None:
        newest = values.agg(F.max("changed_at").alias("newest"))
    dated = values.crossJoin(F.broadcast(newest))
    days = F.coalesce(F.datediff("newest", "changed_at"), F.lit(20 * 365))
    trust = F.pow(F.lit(0.5), F.least(F.col("trust_rank"), F.lit(30)) - 1)
    weight = trust * F.pow(F.lit(0.5), days / F.lit(HALF_LIFE_DAYS))
    summed = dated.groupBy(*by, normalised(F.col("field_name"), F.col("value")).alias("norm")).agg(
        F.round(F.sum(weight), 9).alias("vote"), F.min(best).alias("b")
    )
    leading = [F.col("b.trust_rank"), F.col("b.age"), F.col("b.legacy_vendor_id")]
    behind = F.struct(*(leading if votes == "rank" else [-F.col("vote"), *leading]))
    won = summed.groupBy(*by).agg(F.min_by(F.struct("b.value", "b.legacy_vendor_id", "vote"), behind).alias("w"))
    return won.select(*by, "w.*")


def golden_records(
    groups: DataFrame, vendors: DataFrame, sources: DataFrame, fields: list[str] = FIELDS, votes: str = "sum"
) -> DataFrame:
    """One row per group: for each field a struct (value, legacy_vendor_id, vote) of the value that won; NULL where no
    member has a usable value."""
    newest = vendors.agg(F.max("changed_at").alias("newest"))
    won = survivors(member_values(groups, vendors, sources, fields), votes, newest)
    wide = won.groupBy("group_id").pivot("field_name", fields).agg(F.first(F.struct("value", "legacy_vendor_id", "vote")))
    everyone = groups.select("group_id").where("group_id is not null").distinct()
    return everyone.join(wide, "group_id", "left")


def winners(golden: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(group_id, field_name, legacy_vendor_id): the fields of :func:`golden_records` as rows, without empty ones."""
    ids = golden.select("group_id", *(F.col(f"{f}.legacy_vendor_id").alias(f) for f in fields))
    return ids.unpivot(["group_id"], fields, "field_name", "legacy_vendor_id").where("legacy_vendor_id is not null")
