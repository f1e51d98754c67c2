"""Post records, stances and hierarchy from the rows of a social-media dump, all as column expressions.

Names are kept as arrays of structs (id, name, kind); keys fold case and keep combining marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.dates import iso_time, posted_at
from lumenfold.functions.text import clean_name, clean_text, json_names, key_of_folded

#: Columns read, platforms, languages, names that are no station, author placeholders, kinds of entities.
POST_COLUMNS = (
    "id", "input_text", "post_bank_post_snippet", "post_bank_post_title", "contextual_understanding", "primary_district", "district_names", "primary_thana", "thana_names", "broad_category", "sub_category", "person_names", "organisation_names",
    "location_names", "incidents", "hashtags", "mention_ids_extracted", "unique_topic_id", "topic_title", "post_bank_core_source", "post_bank_source", "source_type", "post_bank_author_username", "post_bank_author_name", "post_bank_post_url",
    "post_bank_post_timestamp", "created_at", "detected_language", "sentiment_label", "emotional_primary_emotion",
)
PLATFORMS = {"twitter": "twitter", "x": "twitter", "facebook": "facebook", "instagram": "instagram", "whatsapp": "whatsapp", "youtube": "youtube", "news_rss_feed": "news", "web": "news", "news": "news"}
LANGUAGES = {"hinglish": "hi", "hindi": "hi", "english": "en"}
NO_STATION = ("क्षेत्र", "थाना", "थाना क्षेत्र", "क्षेत्र का मामला", "इलाका", "इलाके", "कोतवाली क्षेत्र", "area")
NO_AUTHOR = ("unknown_id", "unknown", "none", "null", "anonymous")
ENTITY_KINDS = {"person_names": "person", "organisation_names": "organisation", "location_names": "location", "incidents": "incident"}
LINKS = {"topic": "PART_OF", "account": "POSTED_BY", "mentions": "MENTIONS_ACCOUNT", "districts": "IN_DISTRICT", "thanas": "IN_THANA", "categories": "IN_CATEGORY", "sub_categories": "IN_SUBCATEGORY", "entities": "MENTIONS", "hashtags": "TAGGED"}
LABELS = {"topic": "Topic", "account": "Account", "mentions": "Account", "districts": "District", "thanas": "Thana", "categories": "Category", "sub_categories": "SubCategory", "entities": "SocialEntity", "hashtags": "Hashtag"}
REF = "struct<id:string,name:string,kind:string>"


def key(name: Column) -> Column:
    return key_of_folded(F.lower(name))


def _ref(id_: Column, name: Column, kind: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), name.alias("name"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"))


def _mapped(values: dict[str, str], by: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[by]


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _first_of_id(refs: Column) -> Column:
    """One struct for each id, the first."""
    ids = F.transform(refs, lambda r: r["id"])
    return F.filter(refs, lambda r, i: F.array_position(ids, r["id"]) == i + 1)


def gazetteer(aliases: DataFrame) -> Column:
    """A map from a lower-case spelling to a district's one name, of a small dimension (alias, name): at most a few hundred
    rows, so it is a literal of the plan."""
    rows = aliases.select(F.lower("alias").alias("alias"), "name").union(aliases.select(F.lower("name"), "name")).distinct().orderBy("alias", "name").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("a gazetteer of more than 5000 spellings has to be joined, not inlined")
    return F.create_map(*[F.lit(x) for r in {r["alias"]: r["name"] for r in reversed(rows)}.items() for x in r]) if rows else F.create_map().cast("map<string,string>")


def _account(platform: Column, handle: Column) -> Column:
    bare = F.regexp_replace(F.trim(handle), "^@+", "")
    ref = _ref(F.concat(F.lit("account:"), platform, F.lit(":"), F.lower(bare)), F.concat(F.lit("@"), bare))
    return F.when(key(bare) != "", ref)


def normalize_posts(rows: DataFrame, districts: Column, post_chars: int = 2000, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Posts, the newest first, and counts of skipped rows by reason.

    ``rows`` has POST_COLUMNS as text; ``districts`` is a map of spellings. Rows without text and summary, or without a whole
    number as id, are skipped; a limit keeps the newest valid ones."""
    named = {c: F.col(c) for c in POST_COLUMNS}
    text = F.coalesce(_filled(named["input_text"]), _filled(named["post_bank_post_snippet"]), _filled(named["post_bank_post_title"]), F.lit(""))
    summary = _filled(named["contextual_understanding"])
    why = F.when(F.try_to_number(named["id"], F.lit("999999999999999999")).isNull(), "malformed row").when((F.trim(text) == "") & summary.isNull(), "no text")
    marked = rows.withColumn("why", why).withColumn("row_id", F.col("id").try_cast("long"))
    skipped = marked.filter("why IS NOT NULL").groupBy(F.col("why").alias("reason")).agg(F.count("*").alias("n"))
    good = marked.filter("why IS NULL")
    if limit:
        newest = good.orderBy(F.desc("row_id")).limit(limit)
        over = good.agg((F.count("*") - limit).alias("n")).filter("n > 0").select(F.lit("over the limit").alias("reason"), "n")
        good, skipped = newest, skipped.union(over)

    raw = F.lower(F.coalesce(_filled(named["post_bank_core_source"]), _filled(named["post_bank_source"]), _filled(named["source_type"]), F.lit("")))
    platform = F.coalesce(_mapped(PLATFORMS, raw), F.when(raw == "", "unknown").otherwise(raw))
    either = lambda a, b: F.when(F.size(json_names(named[a])) > 0, json_names(named[a])).otherwise(json_names(named[b]))
    canonical = lambda n: F.coalesce(F.element_at(districts, F.lower(F.trim(n))), F.trim(n))
    good = good.withColumn("platform", platform).withColumn("districts", _first_of_id(F.transform(either("primary_district", "district_names"), lambda n: _ref(F.concat(F.lit("district:"), key(canonical(n))), canonical(n)))))
    first = F.get("districts", F.lit(0))
    scope = F.coalesce(F.regexp_replace(first["id"], "^district:", ""), F.lit("unknown"))
    station = lambda n: ~n.isin(*NO_STATION) & ~F.lower(n).isin(*NO_STATION) & (F.size(F.split(n, " ")) <= 3)
    thanas = F.transform(F.filter(either("primary_thana", "thana_names"), station), lambda n: _ref(F.concat(F.lit("thana:"), scope, F.lit(":"), key(n)), n, first["name"]))
    entities = F.concat(*[F.transform(json_names(named[c]), lambda n: _ref(F.concat(F.lit("entity:"), key(n)), n, F.lit(kind))) for c, kind in ENTITY_KINDS.items()])
    upper = lambda c, prefix: F.transform(json_names(named[c]), lambda n: _ref(F.concat(F.lit(prefix), key(n)), F.upper(n)))
    author = named["post_bank_author_username"]
    good = good.withColumn("account", F.when(author.isNotNull() & ~F.lower(author).isin(*NO_AUTHOR), _account(F.col("platform"), author)))
    tags = F.filter(F.transform(json_names(named["hashtags"]), lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: key(t) != "")
    mentions = F.filter(F.transform(json_names(named["mention_ids_extracted"]), lambda h: _account(F.col("platform"), h)), lambda m: m.isNotNull() & ~m["id"].eqNullSafe(F.col("account.id")))
    topic = _filled(named["unique_topic_id"])
    posts = good.select(
        F.concat(F.lit("post:"), F.col("row_id").cast("string")).alias("post_id"), "row_id", clean_text(text, post_chars).alias("text"), clean_text(summary, post_chars).alias("summary"), _filled(named["post_bank_post_url"]).alias("url"), "platform",
        F.regexp_replace(F.col("account.name"), "^@+", "").alias("author"), clean_name(named["post_bank_author_name"]).alias("author_name"), posted_at(named["post_bank_post_timestamp"], named["created_at"]).alias("posted_at"),
        F.coalesce(_mapped(LANGUAGES, F.lower(F.coalesce(named["detected_language"], F.lit("")))), F.lit("unknown")).alias("language"), F.lower(_filled(named["sentiment_label"])).alias("sentiment"), F.lower(_filled(named["emotional_primary_emotion"])).alias("emotion"),
        F.when(topic.isNotNull(), _ref(F.concat(F.lit("topic:"), topic), F.coalesce(clean_name(named["topic_title"]), topic))).alias("topic"), "account", "districts", thanas.alias("thanas"), upper("broad_category", "category:").alias("categories"),
        upper("sub_category", "subcategory:").alias("sub_categories"), _first_of_id(entities).alias("entities"), F.transform(tags, lambda t: _ref(F.concat(F.lit("hashtag:"), key(t)), F.concat(F.lit("#"), t))).alias("hashtags"), _first_of_id(mentions).alias("mentions"),
    )
    return posts, skipped


def normalize_stances(rows: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stances (analyzed_data_id, entity_name, stance, confidence as text) of kept posts, and how many others there were."""
    own = rows.withColumn("row_id", F.col("analyzed_data_id").try_cast("long"))
    kept = own.join(posts.select("row_id"), "row_id", "left_semi").withColumn("name", clean_name(F.col("entity_name"))).filter("name IS NOT NULL")
    lost = own.join(posts.select("row_id"), "row_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("stance for a post not in the dump").alias("reason"), "n")
    stance = F.lower(F.coalesce(_filled(F.col("stance")), F.lit("neutral")))
    return kept.select(F.concat(F.lit("post:"), F.col("row_id").cast("string")).alias("post_id"), _ref(F.concat(F.lit("entity:"), key(F.col("name"))), F.col("name"), F.lit("entity")).alias("entity"), stance.alias("stance"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence")), lost


def hierarchy(thana_matrix: DataFrame, broad: DataFrame, sub: DataFrame, keywords: DataFrame, districts: Column) -> tuple[DataFrame, DataFrame]:
    """Stations with district and unit, and sub-categories with category and keyword aliases."""
    m = thana_matrix.withColumn("d", clean_name(F.col("district"))).withColumn("t", clean_name(F.col("thana"))).filter("d IS NOT NULL AND t IS NOT NULL")
    district = F.coalesce(F.element_at(districts, F.lower("d")), F.col("d"))
    unit = F.coalesce(*[clean_name(F.col(c)) for c in ("commissionarate", "dist_range", "zone")])
    kind = F.when(_filled(F.col("commissionarate")).isNotNull(), "commissionerate").when(_filled(F.col("dist_range")).isNotNull(), "range").when(_filled(F.col("zone")).isNotNull(), "zone")
    stations = m.select(F.concat(F.lit("thana:"), key(district), F.lit(":"), key(F.col("t"))).alias("id"), F.col("t").alias("name"), F.concat(F.lit("district:"), key(district)).alias("district_id"), district.alias("district"), F.when(unit.isNotNull(), F.concat(F.lit("unit:"), key(unit))).alias("unit_id"), unit.alias("unit"), kind.alias("unit_kind"))
    parents = broad.select(F.col("id").alias("broad_category_id"), F.upper(clean_name(F.col("broad_category"))).alias("category"))
    subs = sub.join(parents, "broad_category_id", "left").withColumn("name", F.upper(clean_name(F.col("sub_category")))).filter("name IS NOT NULL")
    columns = F.array(*[F.struct(F.lit(i).alias("at"), F.coalesce(F.col(c), F.lit("")).alias("words")) for i, c in enumerate(("hindi_keyword", "english_keyword", "hinglish_keyword"))])
    words = keywords.withColumn("name", F.upper(clean_name(F.col("sub_category_name")))).filter("name IS NOT NULL").select("name", F.explode(columns).alias("c")).select("name", "c.at", F.posexplode(F.split("c.words", ",")).alias("pos", "word"))
    fit = words.withColumn("word", F.trim("word")).filter(F.length("word").between(3, 40))
    aliases = fit.groupBy("name").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "pos", "word"))), lambda x: x["word"])).alias("aliases"))
    out = subs.join(aliases, "name", "left").select(F.concat(F.lit("subcategory:"), key(F.col("name"))).alias("id"), "name", F.when(F.col("category").isNotNull(), F.concat(F.lit("category:"), key(F.col("category")))).alias("category_id"), "category", "hint", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return stations, out


def header(p: str = "") -> Column:
    """The line of facts above a post's text."""
    c = lambda n: F.col(p + n)
    names = lambda n: F.transform(c(n), lambda r: r["name"])
    labelled = lambda label, refs, sep: F.when(F.size(refs) > 0, F.concat(F.lit(label), F.array_join(refs, sep)))
    kinds = F.array_distinct(F.concat(names("categories"), names("sub_categories")))
    parts = [c("platform"), F.concat(F.lit("@"), c("author")), F.date_format(c("posted_at"), "yyyy-MM-dd"), labelled("district: ", names("districts"), ", "), labelled("thana: ", names("thanas"), ", "), labelled("category: ", kinds, " / "), F.concat(F.lit("sentiment: "), c("sentiment"))]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def document_text() -> Column:
    return F.concat_ws("\n", header(), F.concat(F.lit("Topic: "), F.col("topic.name")), F.col("text"), F.concat(F.lit("Summary: "), F.col("summary")))


def post_chunks(posts: DataFrame) -> DataFrame:
    """Posts as chunks, with the columns that filters use."""
    names = lambda c: F.transform(F.col(c), lambda r: r["name"])
    at = iso_time(F.col("posted_at"))
    pairs = {
        "platform": F.col("platform"), "author": F.col("author"), "district": F.array_join(names("districts"), ", "), "category": F.array_join(F.concat(names("categories"), names("sub_categories")), " / "), "sentiment": F.col("sentiment"), "posted_at": at,
        "url": F.col("url"), "row_id": F.col("row_id").cast("string"),
    }
    metadata = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull() & (v != ""))
    return posts.select(
        F.col("post_id").alias("chunk_id"), F.coalesce("topic.id", "post_id").alias("doc_id"), F.coalesce("url", "post_id").alias("source"), F.lit("post").alias("doc_type"), F.lit(0).alias("chunk_index"), document_text().alias("text"), F.col("topic.name").alias("section"),
        "language", at.alias("date_start"), at.alias("date_end"), F.when(at.isNotNull(), F.array(F.date_format("posted_at", "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>")).alias("dates"), metadata.alias("metadata"), names("districts").alias("district"),
        names("thanas").alias("thana"), "platform", "sentiment", names("categories").alias("broad_category"), names("sub_categories").alias("sub_category"), F.col("topic.id").alias("topic_id"), "author", F.transform("entities", lambda r: r["id"]).alias("entity_ids"),
    )


def post_graph(posts: DataFrame, stances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of posts. Of a vertex's spellings the newest post's first one counts, and its first kind."""
    one = {c: F.array_compact(F.array(c)) if c in ("topic", "account") else F.col(c) for c in LINKS}
    links = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(LABELS[c]).alias("label"), F.lit(LINKS[c]).alias("rel"), one[c].alias("refs")) for i, c in enumerate(LINKS)])
    flat = posts.select("post_id", "row_id", F.explode(links).alias("l")).select("post_id", "row_id", "l.order", "l.label", "l.rel", F.posexplode("l.refs").alias("pos", "ref"))
    edges = flat.select(F.col("post_id").alias("src"), F.col("ref.id").alias("dst"), "rel", F.lit(None).cast("string").alias("stance"), F.lit(None).cast("double").alias("confidence")).distinct()
    held = stances.groupBy("post_id", "entity.id").agg(F.max_by("stance", "confidence").alias("stance"), F.max("confidence").alias("confidence"))
    edges = edges.union(held.select(F.col("post_id").alias("src"), F.col("id").alias("dst"), F.lit("STANCE").alias("rel"), "stance", "confidence"))
    order = F.struct(-F.col("row_id"), "order", "pos")
    seen = flat.select("label", "ref", order.alias("at")).union(stances.select(F.lit("SocialEntity"), F.col("entity"), F.struct(F.lit(1).cast("long"), F.lit(99), F.lit(0))))
    vertices = seen.groupBy(F.col("ref.id").alias("id")).agg(F.min_by("label", "at").alias("label"), F.min_by("ref.name", "at").alias("name"), F.min_by("ref.kind", F.when(F.col("ref.kind").isNotNull(), F.col("at"))).alias("kind"))
    own = posts.select(F.col("post_id").alias("id"), F.lit("Post").alias("label"), F.col("post_id").alias("name"), F.lit(None).cast("string").alias("kind"))
    return vertices.union(own), edges


def hierarchy_edges(stations: DataFrame, subs: DataFrame, posts: DataFrame) -> DataFrame:
    """Station to district, district to unit, sub-category to category; a post's stations lie in its first district."""
    of_post = posts.filter(F.size("districts") > 0).select(F.explode("thanas").alias("t"), F.get("districts", F.lit(0)).alias("d")).select(F.col("t.id").alias("src"), F.col("d.id").alias("dst"), F.lit("IN_DISTRICT").alias("rel"))
    rows = [
        stations.select(F.col("id").alias("src"), F.col("district_id").alias("dst"), F.lit("IN_DISTRICT").alias("rel")), stations.filter("unit_id IS NOT NULL").select(F.col("district_id").alias("src"), F.col("unit_id").alias("dst"), F.lit("IN_UNIT").alias("rel")),
        subs.filter("category_id IS NOT NULL").select(F.col("id").alias("src"), F.col("category_id").alias("dst"), F.lit("UNDER").alias("rel")), of_post,
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


