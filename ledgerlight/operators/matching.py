"""Addresses to municipalities, towns and positions, and facilities to rows of other sources.

Every join has an equality beside its prefix or distance condition, so that no
plan is a cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BLOCK, BLOCK_CHO, BLOCK_HYPHEN, COUNTY_OR_CITY, HOURS_SOURCE, LAND_SOURCE, PARCEL, PARCEL_BASE, PHARMACY, PREFECTURES, RESIDENCE, STREET, TOWN
from ..functions.geo import METRES_PER_DEGREE, haversine, line_middle
from ..functions.text import address_key, house_numbers, name_key, normalize_for_matching, normalize_station


def municipality_names(municipalities: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    """(prefecture_code, name, code): full names, and names without county or city where they are unique and no full name."""
    full = municipalities.select("prefecture_code", normalize_for_matching(F.col("name"), variants).alias("name"), "code")
    cut = F.coalesce(*[F.nullif(F.regexp_extract("name", COUNTY_OR_CITY, g), F.lit("")) for g in (1, 2)])
    short = full.withColumn("name", cut).filter("name IS NOT NULL").groupBy("prefecture_code", "name").agg(F.min("code").alias("code"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return full.unionByName(short.join(full, ["prefecture_code", "name"], "left_anti"))


#: By so many first characters names are told apart before their lengths are tried.
HEAD = 3


def begun_by(rows: DataFrame, names: DataFrame, scope: list[str], text: str, name: str) -> DataFrame:
    """Rows with each name of their scope that their text begins with.

    Of the names that share a text's first characters only the lengths are looked
    up, and of the text only its beginnings of these lengths meet the names, by
    equality.  So a row gives as many candidates as such names have lengths, and
    most of them are hits.
    """
    some = names.filter(F.length(name) > 0)
    lengths = some.groupBy(*scope, F.substring(name, 1, HEAD).alias("_head")).agg(F.collect_set(F.length(name)).alias("_lengths"))
    heads = F.array_distinct(F.array(*[F.substring(text, 1, n) for n in range(1, HEAD + 1)]))
    tried = rows.withColumn("_head", F.explode(heads)).join(lengths, [*scope, "_head"])
    beginnings = F.transform(F.filter("_lengths", lambda n: n <= F.length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))
    asked = tried.select(*rows.columns, F.explode(beginnings).alias("_begins"))
    return asked.join(some.withColumn("_begins", F.col(name)), [*scope, "_begins"]).drop("_begins")


def prefix_matches(rows: DataFrame, names: DataFrame, scope: list[str], text: str, key: list[str]) -> DataFrame:
    """(key, code, n): of each row the longest name of its scope that its text begins with, and the name's length.

    No more of a text is carried along than the longest name has characters.
    """
    near = names.select(*scope, F.col("name").alias("_name"), F.col("code").alias("_code"))
    longest = near.agg(F.coalesce(F.max(F.length("_name")), F.lit(0)).alias("_most"))
    some = rows.select(*dict.fromkeys([*key, *scope]), F.substring(F.col(text), F.lit(1), longest.scalar()).alias("_text"))
    order = F.struct(F.length("_name").alias("n"), F.col("_code").alias("code"))
    found = begun_by(some, near, scope, "_text", "_name")
    return found.groupBy(*key).agg(F.max(order).alias("b")).select(*key, "b.code", "b.n")


def longest_prefix(rows: DataFrame, names: DataFrame, scope: list[str], text: str, key: list[str]) -> DataFrame:
    """(key, code, remainder): of each row the longest name of its scope that its text begins with, and what follows it."""
    found = prefix_matches(rows, names, scope, text, key)
    rest = F.substr(F.col(text), F.col("n") + 1).alias("remainder")
    return rows.join(found, key).select(*key, "code", rest)


def resolve_municipality(rows: DataFrame, names: DataFrame, key: list[str], variants: dict[str, str] | None = None) -> DataFrame:
    """Rows (prefecture_code, address) with ``municipality_code`` and ``remainder``; nulls where no name fits.

    An address on an island, by its first six characters, is tried again after it.
    """
    own = F.lit(None).cast("string")
    for code, label in PREFECTURES.items():
        own = F.when(F.col("prefecture_code") == code, label).otherwise(own)
    plain = normalize_for_matching(F.col("address"), variants)
    text = F.when(F.startswith(plain, own), F.substr(plain, F.length(own) + 1)).otherwise(plain)
    asked = rows.select(*dict.fromkeys([*key, "prefecture_code"]), text.alias("_address"))
    direct = longest_prefix(asked, names, ["prefecture_code"], "_address", key)
    place = F.instr(F.col("_address"), F.lit("島"))
    island = asked.filter((place > 0) & (place <= 6)).join(direct.select(*key), key, "left_anti")
    after = longest_prefix(island.withColumn("_address", F.substr("_address", place + 1)), names, ["prefecture_code"], "_address", key)
    return rows.join(direct.unionByName(after).withColumnRenamed("code", "municipality_code"), key, "left")


def town_spellings(towns: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    """(lg_code, spelling, machiaza_id, residential, parcel, rule, bytes, kind) of towns that are not abolished.

    Rule 1: town and block number before a hyphen (``spelling`` the town,
    ``chome`` the number); rule 2: names in full, longest in bytes first;
    rule 3: small areas alone, where unique.
    """
    live = towns.filter(F.coalesce("ablt_date", F.lit("")) == "")
    own = Window.partitionBy("lg_code", "machiaza_id")
    norm = lambda c: normalize_for_matching(F.coalesce(c, F.lit("")), variants)
    base = live.select(
        "lg_code", "machiaza_id", "ord", F.coalesce("chome_number", F.lit("")).alias("chome"), norm(F.col("chome")).alias("_chome"),
        F.regexp_replace(norm(F.col("oaza_cho")), "^(大字|字)", "").alias("oaza"), F.regexp_replace(norm(F.col("koaza")), "^字", "").alias("koaza"),
        F.max(F.col("rsdt_addr_flg") == "1").over(own).alias("residential"), F.max(F.col("rsdt_addr_flg") != "1").over(own).alias("parcel"),
    )
    middle = F.concat("oaza", F.when(F.col("chome") != "", F.concat("chome", F.lit("丁目"))).otherwise(""))
    columns = ["lg_code", "machiaza_id", "residential", "parcel", "ord"]
    named = lambda rows, spelling, rule: rows.select(*columns, spelling.alias("spelling"), F.lit("").alias("chome"), F.lit(rule).alias("rule"), F.lit(False).alias("cho"))
    small = base.filter("koaza <> ''")
    full = named(base, F.concat(middle, "koaza"), 2).unionByName(named(small, F.concat(middle, F.lit("字"), "koaza"), 2))
    alone = lambda rows, spelling: rows.withColumn("_s", spelling).groupBy("lg_code", "_s").agg(F.count_distinct("machiaza_id").alias("n"), F.min_by(F.struct(*columns[1:]), "ord").alias("t")).filter("n = 1").select("lg_code", "t.*", F.col("_s").alias("spelling"))
    without = alone(small, middle).join(full.select("lg_code", "spelling"), ["lg_code", "spelling"], "left_anti")
    areas = alone(small, F.col("koaza"))
    blocks = base.filter("chome <> ''").withColumn("cho", F.max(F.endswith("_chome", F.lit("丁"))).over(Window.partitionBy("lg_code", "oaza")))
    out = full.unionByName(named(without, F.col("spelling"), 2)).unionByName(named(areas, F.col("spelling"), 3))
    out = out.unionByName(blocks.select(*columns, F.col("oaza").alias("spelling"), "chome", F.lit(1).alias("rule"), "cho"))
    first = Window.partitionBy("lg_code", "rule", "spelling", "chome").orderBy("ord")
    return out.filter("spelling <> ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("bytes", F.octet_length("spelling"))


def match_town(rows: DataFrame, spellings: DataFrame, key: list[str]) -> DataFrame:
    """(key, machiaza_id, residential, parcel, rest) of rows (lg_code, remainder) whose town is found.

    A town with a numbered block that does not exist ends the search; street
    directions in front are passed over only where nothing else fits.
    """
    tidy = lambda c: F.regexp_replace(c, r"^\s*(大字|字)?", "")
    tries = F.array(F.struct(F.lit(0).alias("turn"), tidy(F.col("remainder")).alias("text")), F.struct(F.lit(1).alias("turn"), F.when(F.col("remainder").rlike(STREET), tidy(F.regexp_replace("remainder", STREET, ""))).alias("text")))
    asked = rows.select(*key, "lg_code", F.explode(tries).alias("t")).select(*key, "lg_code", "t.*").filter("text IS NOT NULL")
    met = begun_by(asked, spellings, ["lg_code"], "text", "spelling")
    after = F.substr("text", F.length("spelling") + 1)
    hyphen, cho = BLOCK_HYPHEN, BLOCK_CHO
    number = F.regexp_replace(F.regexp_extract("_after", cho, 1), "^0+(?=[0-9])", "")
    kanji = F.regexp_replace(normalize_for_matching(F.concat(F.regexp_extract("_after", cho, 1), F.lit("丁目"))), "丁目$", "")
    said = F.when(number.rlike("^[0-9]+$"), number).otherwise(kanji)
    met = met.withColumn("_after", after)
    hit = F.when(F.col("rule") > 1, True).otherwise((F.regexp_extract("_after", hyphen, 1) == F.col("chome")) | (F.col("cho") & F.col("_after").rlike(cho) & (said == F.col("chome"))))
    dead = (F.col("rule") == 1) & F.col("cho") & F.col("_after").rlike(cho)
    rest = F.when(F.col("rule") > 1, F.col("_after")).otherwise(F.regexp_replace("_after", f"(?:{hyphen})|(?:{cho})", ""))
    ranked = met.withColumns({"hit": hit, "dead": dead, "rest": rest}).filter("hit OR dead")
    order = F.struct("turn", "rule", F.when(F.col("hit"), 0).otherwise(1), -F.col("bytes"), "ord")
    best = ranked.groupBy(*key).agg(F.min_by(F.struct("hit", "machiaza_id", "residential", "parcel", "rest"), order).alias("b"))
    return best.filter("b.hit").select(*key, "b.machiaza_id", "b.residential", "b.parcel", "b.rest")


def _bare(c: str) -> Column:
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def _live(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("ablt_date", F.lit("")) == "")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.filter((F.coalesce("rep_lat", F.lit("")) != "") & (F.coalesce("rep_lon", F.lit("")) != ""))


def parcel_positions(parcels: DataFrame, positions: DataFrame) -> DataFrame:
    """(lg_code, machiaza_id, first, second, lat, lon) of parcels with a position; second is null for those without branch."""
    at = _placed(positions).groupBy("lg_code", "machiaza_id", "prc_id").agg(F.min_by(F.struct("rep_lat", "rep_lon"), F.coalesce("ord", F.lit(0))).alias("p"))
    both = _live(parcels).join(at, ["lg_code", "machiaza_id", "prc_id"])
    return both.select("lg_code", "machiaza_id", "prc_id", _bare("prc_num1").alias("first"), F.nullif(_bare("prc_num2"), F.lit("")).alias("second"), F.col("p.rep_lat").cast("double").alias("lat"), F.col("p.rep_lon").cast("double").alias("lon"))


def parcel_base(parcels: DataFrame) -> DataFrame:
    """Of each parcel number the first branch, by town and parcel id, that has a position."""
    first = F.min_by(F.struct("lat", "lon"), F.struct("machiaza_id", "prc_id")).alias("p")
    return parcels.groupBy("lg_code", "machiaza_id", "first").agg(first)


def geocode(targets: DataFrame, registry: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(key, level, lat, lon) of rows (lg_code, machiaza_id, residential, parcel, rest): the finest level that has a position.

    ``registry``: residences (with blk_num, rsdt_num), blocks (blk_num), parcels
    and towns, each with its position file joined by id as rep_lat, rep_lon.
    """
    numbers = house_numbers(F.col("rest"))
    t = targets.select(*key, "lg_code", "machiaza_id", "residential", "parcel", numbers.alias("n")).select("*", F.col("n.first").alias("first"), F.col("n.second").alias("second")).drop("n")
    t = t.withColumn("parent", F.concat(F.substring("machiaza_id", 1, 4), F.lit("000")))
    town = ["lg_code", "machiaza_id"]
    point = lambda rows, keys, name: rows.groupBy(*keys).agg(F.min_by(F.struct(F.col("rep_lat").cast("double").alias("lat"), F.col("rep_lon").cast("double").alias("lon")), "ord").alias(name))
    homes = _placed(_live(registry["residences"])).filter(F.coalesce("rsdt2_id", F.lit("")) == "").withColumns({"first": _bare("blk_num"), "second": _bare("rsdt_num")})
    blocks = _placed(_live(registry["blocks"])).withColumn("first", _bare("blk_num"))
    parcels = registry["parcels"]
    exact = parcels.filter("second IS NOT NULL").groupBy(*town, "first", "second").agg(F.min_by(F.struct("lat", "lon"), "prc_id").alias("p_parcel"))
    towns = point(_placed(registry["towns"]), town, "p_town")
    found = (
        t.join(point(homes, [*town, "first", "second"], "p_home"), [*town, "first", "second"], "left")
        .join(exact, [*town, "first", "second"], "left")
        .join(point(blocks, [*town, "first"], "p_block"), [*town, "first"], "left")
        .join(parcel_base(parcels).withColumnRenamed("p", "p_base"), [*town, "first"], "left")
        .join(towns, town, "left")
        .join(towns.select("lg_code", F.col("machiaza_id").alias("parent"), F.col("p_town").alias("p_parent")), ["lg_code", "parent"], "left")
    )
    at = lambda level, name, when: F.when(when & F.col(name).isNotNull(), F.struct(F.lit(level).alias("level"), F.col(f"{name}.lat").alias("lat"), F.col(f"{name}.lon").alias("lon")))
    yes = F.lit(True)
    best = F.coalesce(at(RESIDENCE, "p_home", F.col("residential")), at(PARCEL, "p_parcel", F.col("parcel")), at(BLOCK, "p_block", F.col("residential")), at(PARCEL_BASE, "p_base", F.col("parcel")), at(TOWN, "p_town", yes), at(TOWN, "p_parent", yes))
    return found.select(*key, best.alias("b")).filter("b IS NOT NULL").select(*key, "b.level", "b.lat", "b.lon")


def match_entities(left: DataFrame, right: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """(key, match_id) of rows of ``left`` that one row of ``right`` fits; both have the scope, name_key and address_key.

    First the same name; if several, those of the same address too; if none is
    left and the name has three characters, the same address with one name part
    of the other.  A row is matched only if exactly one is left.
    """
    own = left.select(F.col(key).alias("_id"), *scope, F.col("name_key").alias("_name"), F.col("address_key").alias("_address"))
    other = right.select(*scope, F.col("id").alias("_other"), "name_key", "address_key")
    by_name = own.join(other.withColumnRenamed("name_key", "_name"), [*scope, "_name"])
    summed = by_name.groupBy("_id").agg(F.count("*").alias("n"), F.min("_other").alias("one"), F.count_if(F.col("address_key") == F.col("_address")).alias("m"), F.min(F.when(F.col("address_key") == F.col("_address"), F.col("_other"))).alias("same"))
    named = summed.select("_id", F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("same")).alias("match_id"), (F.when(F.col("n") == 1, 1).otherwise(F.col("m")) > 0).alias("ended"))
    rest = own.join(named.filter("ended").select("_id"), "_id", "left_anti").filter(F.length("_name") >= 3)
    by_address = rest.join(other.withColumnRenamed("address_key", "_address"), [*scope, "_address"])
    part = (F.length("name_key") >= 3) & (F.contains("name_key", F.col("_name")) | F.contains("_name", F.col("name_key")))
    second = by_address.filter(part).groupBy("_id").agg(F.count("*").alias("n"), F.min("_other").alias("match_id")).filter("n = 1")
    both = named.filter("match_id IS NOT NULL").select("_id", "match_id").unionByName(second.select("_id", "match_id"))
    return both.withColumnRenamed("_id", key)


def with_keys(rows: DataFrame, variants: dict[str, str] | None = None) -> DataFrame:
    return rows.withColumns({"name_key": name_key(F.col("name"), variants), "address_key": address_key(F.col("address"), variants)})


def municipality_centers(rows: DataFrame, least: int = 5, finest: int = PARCEL_BASE) -> DataFrame:
    """(municipality_code, lat, lon): mean position of rows at number level, where there are enough."""
    placed = rows.filter((F.col("geocode_level") <= finest) & F.col("municipality_code").isNotNull())
    means = placed.groupBy("municipality_code").agg(F.avg(F.col("latitude").cast("double")).alias("lat"), F.avg(F.col("longitude").cast("double")).alias("lon"), F.count("*").alias("n"))
    return means.filter(F.col("n") >= least).drop("n")


def refine_location(rows: DataFrame, matches: DataFrame, centers: DataFrame, key: str, level: int, town_metres: float, area_metres: float, types: Column | None = None, same_address: bool = False) -> DataFrame:
    """Rows with their position replaced by a match's where theirs is a town's or none, and the match is near enough.

    ``matches`` (key, lat, lon, address_key) are those of another source; near
    enough is within ``town_metres`` of the town, or ``area_metres`` of the
    municipality's centre where there is no position.
    """
    m = matches.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *([F.col("address_key").alias("_address")] if same_address else []))
    c = centers.select("municipality_code", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"))
    both = rows.join(m, key, "left").join(c, "municipality_code", "left")
    near = F.when(F.col("latitude").isNotNull(), haversine(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")) <= town_metres).otherwise(haversine(F.col("_lat"), F.col("_lon"), F.col("_clat"), F.col("_clon")) <= area_metres)
    take = F.coalesce((F.col("geocode_level").isNull() | (F.col("geocode_level") == TOWN)) & F.col("municipality_code").isNotNull() & near, F.lit(False))
    if types is not None:
        take = take & types
    if same_address:
        take = take & F.coalesce(F.col("_address") == F.col("address_key"), F.lit(False))
    fresh = {"latitude": F.col("_lat"), "longitude": F.col("_lon"), "geocode_level": F.lit(level)}
    kinds = dict(rows.dtypes)
    return both.withColumns({n: F.when(take, v.cast(kinds[n])).otherwise(F.col(n)) for n, v in fresh.items()}).select(*rows.columns)


def refine_by_hours_source(rows: DataFrame, matches: DataFrame, centers: DataFrame, key: str) -> DataFrame:
    return refine_location(rows, matches, centers, key, HOURS_SOURCE, 2_000, 30_000)


def refine_by_land_source(rows: DataFrame, matches: DataFrame, centers: DataFrame, key: str) -> DataFrame:
    return refine_location(rows, matches, centers, key, LAND_SOURCE, 10_000, 30_000, F.col("institution_type") != PHARMACY, same_address=True)


def assign_match(rows: DataFrame, matches: DataFrame, key: str, seen_at) -> DataFrame:
    """Stores matches (key, match_id, name_kana, website_url); ``updated_at`` moves only when reading or address of the site change."""
    m = matches.select(key, F.col("match_id").alias("_m"), F.col("name_kana").alias("_k"), F.col("website_url").alias("_w"))
    both = rows.join(m, key, "left")
    changed = ~F.col("name_kana").eqNullSafe(F.col("_k")) | ~F.col("website_url").eqNullSafe(F.col("_w"))
    at = F.when(changed, F.lit(seen_at)).otherwise(F.col("updated_at")).cast(dict(rows.dtypes)["updated_at"])
    return both.withColumns({"updated_at": at, "medical_info_net_id": F.col("_m"), "name_kana": F.col("_k"), "website_url": F.col("_w")}).select(*rows.columns)


#: Positions that a cell holds before it is split, and how often a cell can be split in four.
CROWDED, DEEPEST = 1000, 6


def split_cells(places: DataFrame, cell: float, most: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Cells with places (_y, _x, depth) and, of split ones, a place for each cell of each depth (_y, _x, level, _cy, _cx, _ry, _rx).

    A cell's depth is how often it is halved both ways until none of its parts
    holds more than ``most`` positions.
    """
    part = lambda c, level: F.floor(F.col(c) / (F.lit(cell) / F.pow(F.lit(2.0), level)))
    sizes = places.groupBy("_y", "_x").agg(F.count("*").alias("n"))
    crowded = places.join(sizes.filter(F.col("n") > most).select("_y", "_x"), ["_y", "_x"], "left_semi")
    levels = crowded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    parts = levels.groupBy("_y", "_x", "level", part("_lat", F.col("level")).alias("_cy"), part("_lon", F.col("level")).alias("_cx")).agg(F.count("*").alias("n"), F.min(F.struct("_lat", "_lon")).alias("at"))
    fullest = parts.groupBy("_y", "_x", "level").agg(F.max("n").alias("n"))
    depth = fullest.groupBy("_y", "_x").agg(F.coalesce(F.min(F.when(F.col("n") <= most, F.col("level"))), F.lit(DEEPEST)).alias("depth"))
    cells = sizes.join(depth, ["_y", "_x"], "left").select("_y", "_x", F.coalesce("depth", F.lit(0)).alias("depth"))
    return cells, parts.select("_y", "_x", "level", "_cy", "_cx", F.col("at._lat").alias("_ry"), F.col("at._lon").alias("_rx"))


def nearest(points: DataFrame, places: DataFrame, key: list[str], values: list[str], reach: float = 0.03, cell: float = 0.03, most: int = CROWDED) -> DataFrame:
    """Points (lat, lon) with the ``values`` of the nearest place (lat, lon, id) within ``reach`` degrees either way; nulls without one.

    Both are dealt to cells, and crowded cells are split until no part holds more
    than ``most`` positions (of places at one position the one of least id
    counts).  A point first takes the distance to one place of each part around
    it, from the whole cell down to the smallest, as a bound; then it meets only
    the parts within the least of these distances.
    """
    if reach > cell:
        raise ValueError("cells must be as wide as the reach")
    at = lambda c: F.floor(F.col(c) / cell)
    size = F.lit(cell) / F.pow(F.lit(2.0), F.col("depth"))
    told = F.struct(F.col("id").alias("_id"), *[F.col(v).alias(f"_v_{v}") for v in values])
    alone = places.groupBy(F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).agg(F.min_by(told, "id").alias("_p"))
    near = alone.withColumns({"_y": at("_lat"), "_x": at("_lon")})
    cells, parts = split_cells(near.select("_y", "_x", "_lat", "_lon"), cell, most)
    leaves = near.join(cells, ["_y", "_x"]).withColumns({"_cy": F.floor(F.col("_lat") / size), "_cx": F.floor(F.col("_lon") / size)})
    asked = points.select(*key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    # a place's distance around a point bounds how far its nearest one can be
    steps = asked.withColumns({"_y": at("lat"), "_x": at("lon"), "level": F.explode(F.sequence(F.lit(0), F.lit(DEEPEST)))})
    own = steps.withColumns({c: F.floor(F.col(v) / (F.lit(cell) / F.pow(F.lit(2.0), F.col("level")))) for c, v in (("_cy", "lat"), ("_cx", "lon"))})
    known = own.join(parts, ["_y", "_x", "level", "_cy", "_cx"]).filter((F.abs(F.col("lat") - F.col("_ry")) <= reach) & (F.abs(F.col("lon") - F.col("_rx")) <= reach))
    bounds = known.groupBy(*key).agg(F.min(haversine(F.col("lat"), F.col("lon"), F.col("_ry"), F.col("_rx"))).alias("_far"))
    high = F.coalesce(F.col("_far") / METRES_PER_DEGREE * 1.002 + 1e-9, F.lit(reach))  # a degree is a little shorter than METRES_PER_DEGREE says
    wide = F.coalesce(high / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(90.0)))), F.lit(1e-6)), F.lit(reach))
    boxed = asked.join(bounds, key, "left").withColumns({"_h": F.least(high, F.lit(reach)), "_w": F.least(wide, F.lit(reach))})
    across = lambda c, by, s: F.sequence(F.floor((F.col(c) - F.col(by)) / s), F.floor((F.col(c) + F.col(by)) / s))
    spread = boxed.withColumn("_y", F.explode(across("lat", "_h", F.lit(cell)))).withColumn("_x", F.explode(across("lon", "_w", F.lit(cell))))
    within = spread.join(cells, ["_y", "_x"]).withColumn("_cy", F.explode(across("lat", "_h", size))).withColumn("_cx", F.explode(across("lon", "_w", size)))
    within = within.filter((F.floor(F.col("_cy") / F.pow(F.lit(2.0), F.col("depth"))) == F.col("_y")) & (F.floor(F.col("_cx") / F.pow(F.lit(2.0), F.col("depth"))) == F.col("_x")))
    met = within.select(*key, "lat", "lon", "_y", "_x", "_cy", "_cx").join(leaves.drop("depth"), ["_y", "_x", "_cy", "_cx"])
    met = met.filter((F.abs(F.col("lat") - F.col("_lat")) <= reach) & (F.abs(F.col("lon") - F.col("_lon")) <= reach))
    order = F.struct(haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), F.col("_p._id"))
    best = met.groupBy(*key).agg(F.min_by("_p", order).alias("b"))
    return points.join(best, key, "left").select(*points.columns, *[F.col(f"b._v_{v}").alias(v) for v in values])


def stale_locations(rows: DataFrame) -> DataFrame:
    """Rows never geocoded, or whose address is not the geocoded one any more."""
    return rows.filter(~F.col("geocoded_address").eqNullSafe(F.col("address")))


def reset_locations(rows: DataFrame, level: int) -> DataFrame:
    """After a source was loaded anew: rows at town level, placed by that source, or not placed are to be geocoded again."""
    again = F.col("geocode_level").isNull() | F.col("geocode_level").isin(TOWN, level)
    return rows.withColumn("geocoded_address", F.when(again, F.lit(None).cast("string")).otherwise(F.col("geocoded_address")))


def store_locations(rows: DataFrame, found: DataFrame, key: str, seen_at) -> DataFrame:
    """Writes found positions (key, address, level, lat, lon) to rows whose address is still that one; ``updated_at`` moves with the position only."""
    f = found.select(key, F.col("address").alias("_a"), F.col("level").alias("_l"), F.col("lat").cast("decimal(10,6)").alias("_y"), F.col("lon").cast("decimal(10,6)").alias("_x"))
    both = rows.join(f, key, "left")
    here = F.coalesce(F.collate(F.col("_a"), "UNICODE_CI") == F.collate(F.col("address"), "UNICODE_CI"), F.lit(False))
    moved = here & ~(F.col("_y").eqNullSafe(F.col("latitude").cast("decimal(10,6)")) & F.col("_x").eqNullSafe(F.col("longitude").cast("decimal(10,6)")) & F.col("_l").eqNullSafe(F.col("geocode_level")))
    fresh = {"latitude": (here, F.col("_y")), "longitude": (here, F.col("_x")), "geocode_level": (here, F.col("_l")), "geocoded_address": (here, F.col("_a")), "updated_at": (moved, F.lit(seen_at))}
    kinds = dict(rows.dtypes)
    return both.withColumns({n: F.when(w, v.cast(kinds[n])).otherwise(F.col(n)) for n, (w, v) in fresh.items()}).select(*rows.columns)


def land_locations(features: DataFrame, names: DataFrame, prefecture: Column, variants: dict[str, str] | None = None) -> DataFrame:
    """Typed rows of a land registry's points whose municipality can be read off their address.

    A row's municipality follows from its prefecture and address alone, so these
    are what is looked up, each distinct one once.
    """
    p = features.select(F.col("properties.P04_001").cast("int").alias("institution_type"), F.col("properties.P04_002").alias("name"), F.col("properties.P04_003").alias("address"), F.get("geometry.coordinates", F.lit(1)).alias("latitude"), F.get("geometry.coordinates", F.lit(0)).alias("longitude")).withColumn("prefecture_code", prefecture)
    asked = p.select("prefecture_code", "address").filter("address IS NOT NULL AND prefecture_code IS NOT NULL").distinct()
    placed = resolve_municipality(asked, names, ["prefecture_code", "address"], variants).filter("municipality_code IS NOT NULL")
    keyed = placed.withColumn("address_key", address_key(F.col("remainder"), variants)).drop("remainder")
    return p.join(keyed, ["prefecture_code", "address"]).withColumn("name_key", name_key(F.col("name"), variants))


def station_points(features: DataFrame) -> DataFrame:
    """One row per station code: attributes of its first platform, mean of its platforms' middles; features without code, name or line go."""
    prop = lambda n: F.coalesce(F.col(f"properties.{n}"), F.lit(""))
    good = F.filter("geometry.coordinates", lambda p: (F.size(p) >= 2) & F.element_at(p, 1).isNotNull() & F.element_at(p, 2).isNotNull())
    rows = features.filter(F.col("geometry.type") == "LineString").select(
        "ord", prop("N02_005c").alias("station_code"), prop("N02_005").alias("name"), prop("N02_003").alias("line_name"), prop("N02_004").alias("operator_name"), prop("N02_005g").alias("group_code"), line_middle(good).alias("middle")
    )
    rows = rows.filter("station_code <> '' AND name <> '' AND middle IS NOT NULL")
    first = F.min_by(F.struct("group_code", "name", "line_name", "operator_name"), "ord").alias("f")
    made = rows.groupBy("station_code").agg(first, F.round(F.avg("middle.lat"), 6).alias("latitude"), F.round(F.avg("middle.lon"), 6).alias("longitude"))
    group = F.when(F.col("f.group_code") == "", F.col("station_code")).otherwise(F.col("f.group_code"))
    return made.select("station_code", group.alias("group_code"), "f.name", normalize_station(F.col("f.name")).alias("name_normalized"), "f.line_name", "f.operator_name", "latitude", "longitude")


def station_groups(rows: DataFrame) -> DataFrame:
    """One row per group: the first line's name and area, the mean position, and all lines."""
    first = F.min_by(F.struct("name", "prefecture_code", "municipality_code"), "station_code").alias("f")
    lines = F.array_sort(F.collect_list(F.struct("station_code", F.col("operator_name").alias("operator"), F.col("line_name").alias("line"))))
    made = rows.groupBy("group_code").agg(first, F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"), lines.alias("l"))
    return made.select("group_code", "f.*", "latitude", "longitude", F.transform("l", lambda x: F.struct(x["operator"].alias("operator"), x["line"].alias("line"))).alias("lines"))


def find_stations(rows: DataFrame, name: str, prefecture: str | None = None, most: int = 20, most_rows: int = 200) -> DataFrame:
    """Station groups by name: the name itself, else without its ending, else names that begin with it, shortest first."""
    asked = rows.sparkSession.range(1).select(normalize_station(F.lit(name)).alias("q"))
    found = (rows.filter(F.col("prefecture_code") == prefecture) if prefecture else rows).crossJoin(F.broadcast(asked))  # one row
    n, q = F.col("name_normalized"), F.col("q")
    cut = (F.length(q) > 1) & F.endswith(q, F.lit("駅")) & (n == F.substr(q, F.lit(1), F.length(q) - 1))
    tiered = found.withColumn("tier", F.when(n == q, 1).when(cut, 2).when(F.startswith(n, q), 3)).filter("tier IS NOT NULL")
    best = tiered.agg(F.min("tier").alias("tier"))
    chosen = tiered.join(F.broadcast(best), "tier").orderBy(F.when(F.col("tier") == 3, F.length("name_normalized")).otherwise(0), "station_code")
    limited = chosen.filter("tier < 3").unionByName(chosen.filter("tier = 3").limit(most_rows))
    groups = station_groups(limited)
    return groups.orderBy(F.length("name"), F.coalesce("prefecture_code", F.lit("99")), "name").limit(most)
