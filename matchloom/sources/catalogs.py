"""Card catalog and team documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.digest import table_digest
from matchloom.operators.quality import duplicates
from matchloom.session import path_exists

PROVIDER_CARD = """id string, name string, version string, lang string, collector_number string,
 set struct<code:string,name:string>, inks array<string>, ink string, cost int, inkwell boolean,
 classifications array<string>, type array<string>, text string"""
TEAM = """team struct<slug:string,name:string>,
 members array<struct<preferred_display_name:string,{id_field}:string,role:string>>"""


def _text(c):
    t = F.trim(c)
    return F.when(t != "", t)


def normalize_catalog(docs: DataFrame) -> DataFrame:
    """Provider card documents (``body``) to catalog rows: English only, id = set-number.

    ``errors`` lists missing required parts; the id is NULL then.
    """
    c = docs.select("*", F.from_json("body", PROVIDER_CARD).alias("c"))
    c = c.filter(F.lower(F.coalesce("c.lang", F.lit("en"))) == "en")
    code, number, base = _text("c.set.code"), _text("c.collector_number"), _text("c.name")
    version = _text("c.version")
    inks = F.coalesce("c.inks", F.when(F.col("c.ink").isNotNull(), F.array("c.ink")), F.array())
    clean = lambda a, low: F.filter(F.transform(a, lambda x: F.lower(F.trim(x)) if low else F.trim(x)), lambda x: x != "")  # noqa: E731,E501
    return c.select(
        *docs.columns, F.concat(code, F.lit("-"), number).alias("card_id"),
        F.when(version.isNotNull(), F.concat(base, F.lit(" - "), version)).otherwise(base).alias("name"),
        version.alias("version"), code.alias("set_code"), _text("c.set.name").alias("set_name"),
        number.alias("collector_number"), clean(inks, True).alias("ink_colors"), F.col("c.cost").alias("cost"),
        F.col("c.inkwell").alias("inkable"),
        clean(F.coalesce("c.classifications", F.array()), False).alias("classifications"),
        _text(F.array_join(clean(F.coalesce("c.type", F.array()), False), "/")).alias("card_type"),
        _text("c.text").alias("rules_text"),
        F.filter(F.array(F.when(code.isNull(), "set_code"), F.when(number.isNull(), "collector_number"),
                         F.when(base.isNull(), "name")), lambda e: e.isNotNull()).alias("errors"))


PLAIN_CARD = """id string, card_id string, name string, version string, subtitle string, set_code string,
 set_name string, collector_number string, ink_colors array<string>, colors array<string>,
 classifications array<string>, card_type string, type string, rules_text string, text string"""


def normalize_cards(docs: DataFrame) -> DataFrame:
    """Snapshot card documents (``body``) to catalog rows; ``errors`` names what is wrong.

    Id and name are required; cost must be a number and inkable a boolean, not each other.
    """
    c = docs.select("*", F.from_json("body", PLAIN_CARD).alias("c"), F.try_parse_json("body").alias("_v"))
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(_v, '$.{f}', 'variant'))")
    given = lambda f: F.coalesce(kind(f) != "VOID", F.lit(False))
    either = lambda a, b: _text(F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b)))  # noqa: E731,E501
    cost = F.expr("try_variant_get(_v, '$.cost', 'int')")
    inkable = F.expr("try_variant_get(_v, '$.inkable', 'boolean')")
    cost_ok = ~given("cost") | ((kind("cost") != "BOOLEAN") & cost.isNotNull())
    ink_ok = ~given("inkable") | (kind("inkable") == "BOOLEAN")
    card_id, name = either("c.id", "c.card_id"), _text("c.name")
    colours = F.coalesce(F.when(kind("ink_colors").isNotNull(), F.coalesce("c.ink_colors", F.array())),
                         F.col("c.colors"), F.array())
    clean = lambda a, low: F.filter(F.transform(a, lambda x: F.lower(F.trim(x)) if low else F.trim(x)), lambda x: x != "")  # noqa: E731,E501
    return c.select(
        *docs.columns, card_id.alias("card_id"), name.alias("name"),
        either("c.version", "c.subtitle").alias("version"), _text("c.set_code").alias("set_code"),
        _text("c.collector_number").alias("collector_number"), clean(colours, True).alias("ink_colors"),
        F.when(cost_ok, cost).alias("cost"), F.when(ink_ok, inkable).alias("inkable"),
        clean(F.coalesce("c.classifications", F.array()), False).alias("classifications"),
        either("c.card_type", "c.type").alias("card_type"), either("c.rules_text", "c.text").alias("rules_text"),
        F.filter(F.array(F.when(card_id.isNull(), "card_id"), F.when(name.isNull(), "name"),
                         F.when(~cost_ok, "cost"), F.when(~ink_ok, "inkable")),
                 lambda e: e.isNotNull()).alias("errors"))


def snapshot_problems(cards: DataFrame) -> DataFrame:
    """Ids that occur twice; any row here rejects the whole snapshot."""
    return duplicates(cards.filter(F.col("card_id").isNotNull()), ["card_id"])


def flatten_teams(docs: DataFrame, id_field: str = "player_id") -> DataFrame:
    """Team definition documents to member rows; ``error`` names the first broken field.

    ``id_field`` is the provider's member id. Slugs are trimmed and lower-cased, roles default
    to member, ids are positive whole numbers and occur once per document.
    """
    t = docs.select(*docs.columns, F.from_json("body", TEAM.format(id_field=id_field)).alias("t"))
    slug, name = _text(F.lower("t.team.slug")), _text("t.team.name")
    rows = t.select(*docs.columns, slug.alias("slug"), name.alias("team_name"),
                    F.col(f"t.members.{id_field}").alias("_ids"),
                    F.posexplode_outer("t.members").alias("pos", "m")).filter(F.col("pos").isNotNull())
    number = F.expr(f"try_cast(m.{id_field} as bigint)")
    role = F.trim(F.coalesce(F.when(F.col("m.role") != "", F.col("m.role")), F.lit("member")))
    shown = _text("m.preferred_display_name")
    return rows.select(
        *docs.columns, "slug", "team_name", "pos", shown.alias("display_name"),
        number.alias("player_id"), role.alias("role"),
        F.when(F.col("slug").isNull() | F.col("team_name").isNull(), "team")
        .when(F.coalesce(number <= 0, F.lit(True)), "player_id").when(shown.isNull(), "display_name")
        .when(role == "", "role")
        .when(F.array_position("_ids", F.col(f"m.{id_field}")) <= F.col("pos"), "duplicate_id")
        .alias("error"))


def apply_roster(definition: DataFrame, links: DataFrame, memberships: DataFrame) -> DataFrame:
    """What applying a team definition would do to each member, matched by provider id only.

    ``link_conflict``: the id belongs to another member; a member's first link is primary;
    an open membership is kept, otherwise one is opened.
    """
    known = links.select("player_id", F.col("member_id").alias("linked_member"))
    has_link = links.select("member_id").distinct().withColumn("_has", F.lit(True))
    open_ = memberships.filter(F.col("ended_at").isNull()).select(
        "team_id", "member_id").distinct().withColumn("_open", F.lit(True))
    rows = definition.join(known, "player_id", "left").join(has_link, "member_id", "left").join(
        open_, ["team_id", "member_id"], "left")
    taken = F.col("linked_member").isNotNull() & (F.col("linked_member") != F.col("member_id"))
    return rows.select(
        "team_id", "member_id", "player_id",
        F.when(taken, "link_conflict").when(F.col("linked_member").isNotNull(), "linked")
        .when(F.col("_has").isNotNull(), "add_link").otherwise("add_primary_link").alias("link_action"),
        F.when(taken, "none").when(F.col("_open").isNotNull(), "keep").otherwise("open")
        .alias("membership_action"))


def rule_pages(pages: DataFrame, version: str) -> DataFrame:
    """Pages of a rules document as citable passages with key and checksum."""
    return pages.select(
        F.concat(F.lit(f"CR:{version}:p"), F.col("page").cast("string")).alias("passage_id"),
        "document_id", "text", F.sha2("text", 256).alias("sha256"))


class SnapshotStore:
    """Immutable catalog snapshots, one folder per content hash with an append-only index."""

    INDEX = "snapshot string, card_count long, source string, imported_at timestamp"

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def index(self) -> DataFrame:
        path = f"{self.root}/index"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], self.INDEX)
        return self.spark.read.schema(self.INDEX).parquet(path)

    def write(self, cards: DataFrame, source: str) -> tuple[str, bool]:
        """Store a snapshot; equal content returns the stored one. Repeated ids reject it."""
        nested = ("array", "map", "struct")
        flat = cards.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c)
                              for c, t in cards.dtypes])
        if not snapshot_problems(cards).isEmpty():
            raise ValueError("card ids repeat in the snapshot")
        mark = table_digest(flat, flat.columns).first()
        if not self.index().filter(F.col("snapshot") == mark["digest"]).isEmpty():
            return mark["digest"], False
        cards.write.mode("overwrite").parquet(f"{self.root}/snapshot={mark['digest']}")
        row = self.spark.createDataFrame([(mark["digest"], mark["row_count"], source)],
                                         "snapshot string, card_count long, source string")
        row.withColumn("imported_at", F.current_timestamp()).coalesce(1).write.mode(
            "append").parquet(f"{self.root}/index")
        return mark["digest"], True

    def read(self, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshot={snapshot}")

    def latest(self) -> DataFrame | None:
        row = self.index().orderBy(F.col("imported_at").desc(), "snapshot").first()
        return self.read(row["snapshot"]) if row else None
