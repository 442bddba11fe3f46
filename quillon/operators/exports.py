"""Flat export rows, their filters and the texts that describe them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t


@dataclass(frozen=True)
class Filters:
    """What an export is restricted to; ``all`` and empty tuples restrict nothing."""

    brands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    sizes: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    position: str = "all"
    matched: str = "all"
    fresh: str = "all"
    query: str = ""

    CHOICES = {"position": ("all", "undercut", "winning", "parity"), "matched": ("all", "yes", "no"), "fresh": ("all", "yes", "no")}

    @classmethod
    def parsed(cls, given: dict[str, str | list[str]]) -> Filters:
        """From query parameters: repeated or comma-separated lists, unknown choices are ``all``."""
        many = lambda k: tuple(x.strip() for v in ([given[k]] if isinstance(given.get(k), str) else given.get(k) or []) for x in v.split(",") if x.strip())
        number = lambda k: float(given[k]) if re.fullmatch(r"-?\d+(\.\d+)?", str(given.get(k) or "")) else None
        chosen = {k: given.get(k) if given.get(k) in options else "all" for k, options in cls.CHOICES.items()}
        return cls(many("brand"), many("category"), many("gender"), many("size"), number("min"), number("max"), query=str(given.get("q") or ""), **chosen)

    def sentence(self) -> str:
        """The filters in words."""
        lists = [(n, v) for n, v in (("brand", self.brands), ("category", self.categories), ("gender", self.genders), ("size", self.sizes)) if v]
        said = [f"{n}: {', '.join(v)}" for n, v in lists]
        if self.low is not None or self.high is not None:
            said.append(f"price {self.low if self.low is not None else '…'} to {self.high if self.high is not None else '…'}")
        said += [f"{n}: {getattr(self, n)}" for n in self.CHOICES if getattr(self, n) != "all"]
        return "; ".join(said + ([f"search: {self.query}"] if self.query else [])) or "everything"

    def filename(self, kind: str) -> str:
        """A file name that tells the filters."""
        return "-".join(re.findall("[a-z0-9]+", f"comparisons {self.sentence()}".lower()))[:80] + f".{kind}"

    def conditions(self) -> dict[str, Column]:
        """Conditions by name on export rows; null groups count as 'unclassified' or 'unspecified'."""
        c, out = F.col, {}
        for name, column, wanted, unknown in (("brands", "brand", self.brands, "unspecified"), ("categories", "category", self.categories, "unclassified"),
            ("genders", "gender", self.genders, "unspecified")):
            if wanted:
                out[name] = F.coalesce(c(column), F.lit(unknown)).isin(*wanted)
        if self.sizes:
            out["sizes"] = F.arrays_overlap(c("sizes"), t.literal_array(self.sizes))
        if self.low is not None or self.high is not None:
            out["price"] = c("price").between(self.low if self.low is not None else float("-inf"), self.high if self.high is not None else float("inf"))
        if self.position != "all":
            out["position"] = {"undercut": c("gap") > 0, "winning": c("gap") < 0, "parity": c("gap") == 0}[self.position]
        if self.matched != "all":
            out["matched"] = c("matched") == (self.matched == "yes")
        if self.fresh != "all":
            out["fresh"] = c("fresh") == (self.fresh == "yes")
        return out


def filtered(rows: DataFrame, f: Filters) -> DataFrame:
    """Export rows under all filters, largest gap first. Conditions are built in, so they reach the scan."""
    from quillon.operators.position import search

    kept = rows.where(reduce(lambda a, b: a & b, f.conditions().values(), F.lit(True)))
    return (search(kept, f.query, "brand", "title") if f.query else kept).orderBy(F.col("gap").desc_nulls_last(), "id")


def rows(anchors: DataFrame, decisions: DataFrame, platforms: list[str]) -> DataFrame:
    """One flat row for each anchor: a price, score and match type for each platform, category, gender, sizes and position."""
    from quillon.operators.position import market

    ok = F.col("status") == "matched"
    wide = [F.max(F.when((F.col("platform") == p) & ok, F.col(c))).alias(f"{p}_{c}") for p in platforms for c in ("price", "score", "matchType")]
    sizes = F.array_distinct(F.flatten(F.collect_list(F.when(ok, F.col("sizes")))))
    per = decisions.groupBy(F.col("anchor_id").alias("id")).agg(*wide, sizes.alias("sizes"), F.bool_or(ok).alias("matched"))
    kind = F.coalesce(F.col("category"), t.garment(t.strip_brand(F.col("title"), F.col("brand"))))
    joined = anchors.join(per, "id", "left").withColumns({"category": kind, "gender": F.coalesce("gender", t.gender(F.concat_ws(" ", "brand", "title")))})
    joined = joined.withColumn("sizes", F.filter(F.transform("sizes", t.export_size), lambda s: s.isNotNull()))
    return market(joined, "price", [f"{p}_price" for p in platforms])


#: What a reader of a sheet is told of each status.
STATUS_LABELS = {
    "matched": "Matched", "no_match": "No match", "no_results": "Not listed", "blocked": "Blocked — retry",
    "ambiguous": "Ambiguous — verify", "color_mismatch": "Different colourway", "error": "Error",
}
LISTED = ("title", "mrp", "price", "discount", "url")


def listed(decisions: DataFrame, platforms: list[str]) -> DataFrame:
    """``id`` and for each platform its status with label and, where it is matched, match type, confidence and listing.

    One partial aggregation; of several decisions for an anchor and a platform the matched one with the highest score counts. A platform
    without a decision has the status ``error``. ``matched_count``, ``best_platform`` (highest score, the first platform of equal ones)
    and its ``confidence`` and ``match_type`` stand beside them."""
    ok = F.col("status") == "matched"
    kept = F.struct("status", F.when(ok, F.col("matchType")).alias("match_type"), F.when(ok, F.round("score", 4)).alias("confidence"), *[F.when(ok, F.col(c)).alias(c) for c in LISTED])
    rank = F.struct(ok, F.coalesce("score", F.lit(-1.0)), "status", *LISTED)
    per = decisions.groupBy(F.col("anchor_id").alias("id")).agg(*[F.max_by(F.when(F.col("platform") == p, kept), F.when(F.col("platform") == p, rank)).alias(p) for p in platforms])
    at = lambda p, c: F.col(f"`{p}`.{c}")
    sure = lambda p: F.coalesce(at(p, "confidence"), F.lit(-1.0))
    most = F.greatest(*map(sure, platforms)) if len(platforms) > 1 else sure(platforms[0])
    best = lambda value: F.coalesce(*[F.when((sure(p) == most) & (most >= 0), value(p)) for p in platforms])
    status = lambda p: F.coalesce(at(p, "status"), F.lit("error"))
    wide = [c for p in platforms for c in (status(p).alias(f"{p}_status"), F.coalesce(F.try_element_at(t.literal_map(STATUS_LABELS), status(p)), status(p)).alias(f"{p}_status_label"),
        *[at(p, x).alias(f"{p}_{x}") for x in ("match_type", "confidence", *LISTED)])]
    count = sum((status(p) == "matched").cast("long") for p in platforms)
    return per.select("id", *wide, count.alias("matched_count"), best(F.lit).alias("best_platform"), best(lambda p: at(p, "confidence")).alias("confidence"),
        F.coalesce(best(lambda p: at(p, "match_type")), F.lit("NO MATCH")).alias("match_type"))


def whole_rows(anchors: DataFrame, decisions: DataFrame, platforms: list[str], as_of: Column, ttl_hours: float) -> DataFrame:
    """The whole export row of each anchor (id, price, matched_at and whatever it has else): its listings, position and age.

    Anchors without decisions have ``error`` everywhere; without ``matched_at`` age is null and the row isn't fresh."""
    from quillon.operators.position import market

    empty = {"matched_count": 0, "match_type": "NO MATCH", **{f"{p}_status": "error" for p in platforms}, **{f"{p}_status_label": STATUS_LABELS["error"] for p in platforms}}
    joined = anchors.join(listed(decisions, platforms), "id", "left").fillna(empty)
    age = (as_of.cast("timestamp").cast("double") - F.col("matched_at").cast("timestamp").cast("double")) / 3600
    joined = joined.withColumns({"age_hours": F.round(age, 1), "fresh": F.coalesce(age <= ttl_hours, F.lit(False))})
    return market(joined, "price", [f"{p}_price" for p in platforms])


def coverage(rows: DataFrame) -> DataFrame:
    """How much of an export is matched and fresh: one row; the rate is in per cent, 0 for no rows."""
    matched = F.count_if(F.col("matched_count") > 0)
    rate = F.coalesce(F.round(F.try_divide(matched * 100.0, F.count("*")), 1), F.lit(0.0))
    return rows.agg(F.count("*").alias("products"), matched.alias("matched"), rate.alias("match_rate"), F.count_if("fresh").alias("fresh"))


def explanation(brand: Column, mrp: Column, title: Column, compared: Column, agreed: Column, attributes: Column) -> Column:
    """(why, differences) of a decision, each at most three."""
    why = F.array_compact(F.array(
        F.when(brand >= 0.99, "Identical brand").when(brand >= 0.8, "Brand matches"), F.when(mrp == 1, "Exact MRP match").when(mrp >= 0.55, "Near-identical MRP"),
        F.when(attributes >= 0.85, F.concat(F.lit("Specifications agree ("), agreed.cast("string"), F.lit("/"), compared.cast("string"),
        F.lit(")"))).when(attributes >= 0.6, "Most specifications agree"),
        F.when(title >= 0.7, "Highly similar titles")))
    differences = F.array_compact(F.array(F.when(brand < 0.8, "Brand is different"), F.when(mrp < 0.55, "MRP differs materially")))
    return F.struct(F.slice(why, 1, 3).alias("why"), F.slice(differences, 1, 3).alias("differences"))
