"""Registered queries of the integration operators over the star tables, and their SQL.

Adapters: a part is a product record (name as title and model, brand, type as category, price, size
as screen size); an event's props are a raw payload; orders and line items are claims on customers
and orders. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.functions import text as T
from knitwork.functions import values as V
from knitwork.operators import blocking, clustering, components, decisions, fusion, matching, profile, report, routing, schema_align, subset
from knitwork.plans.integration import integrate
from knitwork.session import cut_lineage, read_table
from knitwork.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def _load() -> None:
    """The modules that register the rest."""
    from knitwork.plans import registry_release  # noqa: F401


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("uid"), F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string")).alias("source_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("model_number"), F.col("p_type").alias("category"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_size").cast("string").alias("screen"), F.lit("").alias("resolution"), F.array(F.lit("record_uid"), F.lit("source_id"), F.concat(F.lit("spec_"), F.lower("p_type"))).alias("spec_keys"))


PRODUCTS = """products as (select lpad(cast(p_partkey as varchar), 8, '0') as uid, 's' || cast(p_partkey % 7 as varchar) as source_id, p_name as title, p_brand as brand,
  p_name || '-' || cast(p_size as varchar) as model_number, p_type as category, cast(p_retailprice as varchar) as price, cast(p_size as varchar) as screen,
  ['record_uid', 'source_id', 'spec_' || lower(p_type)] as spec_keys from part)"""


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower(replace({x}, '_', ' ')), '[a-z0-9]+')"


def sql_tokens(x: str) -> str:
    return f"list_sort(list_distinct({sql_words(x)}))"


def sql_informative(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_filter({sql_tokens(x)}, lambda t: length(t) > 2 and t not in ({stop}))"


def sql_model(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"


def sql_qgrams(x: str) -> str:
    return f"(case when length({x}) = 0 then cast([] as varchar[]) else list_transform(range(1, greatest(length({x}) - 2, 1) + 1), lambda i: substr({x}, i, 3)) end)"


def sql_jaccard(a: str, b: str) -> str:
    return f"(case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0.0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"


def sql_model_tokens(x: str) -> str:
    found = f"list_transform(regexp_extract_all({x}, '(?i)\\b[A-Z]{{0,6}}[0-9]{{2,6}}[A-Z0-9-]*\\b'), lambda t: {sql_model('t')})"
    return f"list_sort(list_distinct(list_filter(list_concat({found}, case when regexp_matches({x}, '[0-9]') then [{sql_model(x)}] else [] end), lambda t: length(t) >= 3)))"


# --- sources


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    uid = V.record_uid(F.lit("part"), F.col("p_partkey").cast("string"))
    return p.select(F.lit("part").alias("source_id"), F.col("p_partkey").cast("string").alias("source_record_id"), V.canonical_json(p.columns).alias("payload"), F.lit(None).cast("string").alias("position"), uid.alias("record_uid"), F.lit(None).cast("string").alias("error_type"))


@query("ingest_records", """select 'part:' || p_partkey as record_uid, 'part' as source_id, cast(p_partkey as varchar) as source_record_id, j as raw_payload, sha256(j) as raw_checksum
from (select p_partkey, cast(to_json({p_brand: p_brand, p_name: p_name, p_partkey: p_partkey, p_retailprice: p_retailprice, p_size: p_size, p_type: p_type}) as varchar) as j from part)""")
def ingest_records(spark, sf_dir):
    return readers.split_records(part_rows(spark, sf_dir))[0].drop("ingested_at")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    record_id = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "row_number").otherwise((F.col("event_id") % 5000).cast("string"))
    rows = e.select(F.col("event_type").alias("source_id"), record_id.alias("source_record_id"), F.when(F.col("event_id") % 10 == 2, "{").otherwise(F.col("props")).alias("payload"), F.col("event_id").cast("string").alias("position"))
    uid = V.record_uid(F.col("source_id"), F.col("source_record_id"))
    bad = F.try_parse_json("payload").isNull()
    return rows.withColumn("record_uid", uid).withColumn("error_type", F.when(bad, "malformed_row").when(uid.isNull(), "unstable_identifier"))


@query("ingest_errors", """with e as (select event_type as source_id, event_id % 10 as m, event_id % 5000 as r from events)
select source_id, case m when 2 then 'malformed_row' else 'unstable_identifier' end as error_type, count(*) as rows from e where m in (0, 1, 2) group by all
union all
select source_id, 'duplicate_identifier', count(*) from (select source_id, r from e where m > 2 group by all having count(*) > 1) group by all""")
def ingest_errors(spark, sf_dir):
    return readers.split_records(event_rows(spark, sf_dir))[1].groupBy("source_id", "error_type").agg(F.count("*").alias("rows"))


@query("source_manifest", """with d as (select event_type as source_id, min(props) as p from events where event_id % 10 > 2 group by event_type, event_id % 5000)
select source_id, count(*) as record_count, sha256(string_agg(sha256(p), '' order by sha256(p))) as input_checksum from d group by 1""")
def source_manifest(spark, sf_dir):
    return readers.manifest(readers.split_records(event_rows(spark, sf_dir))[0])


@query("explode_payload", """select 'part:' || p_partkey as record_uid, u.attr_ord, u.attribute, u.value from (select p_partkey, unnest([
  {attr_ord: 0, attribute: 'p_brand', value: p_brand}, {attr_ord: 1, attribute: 'p_name', value: p_name}, {attr_ord: 2, attribute: 'p_partkey', value: cast(p_partkey as varchar)},
  {attr_ord: 3, attribute: 'p_retailprice', value: cast(p_retailprice as varchar)}, {attr_ord: 4, attribute: 'p_size', value: cast(p_size as varchar)}, {attr_ord: 5, attribute: 'p_type', value: p_type}]) as u from part)""")
def explode_payload(spark, sf_dir):
    return profile.explode_payload(readers.split_records(part_rows(spark, sf_dir))[0]).select("record_uid", "attr_ord", "attribute", "value")


# --- profiling


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(c).cast("string").alias("value")) for n, c in (("brand", "p_brand"), ("product name", "p_name"), ("price", "p_retailprice"), ("size", "p_size"), ("category", "p_type"))])
    return p.select(F.lit("part").alias("source_id"), F.col("p_partkey").alias("ord"), F.explode(pairs).alias("x")).select("source_id", "ord", "x.*")


VALUES = """v as (select 'part' as source_id, p_partkey as ord, u.attribute, u.value from (select p_partkey, unnest([{attribute: 'brand', value: p_brand}, {attribute: 'product name', value: p_name},
  {attribute: 'price', value: cast(p_retailprice as varchar)}, {attribute: 'size', value: cast(p_size as varchar)}, {attribute: 'category', value: p_type}]) as u from part))"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = part_values(spark, sf_dir)
    return profile.attribute_profiles(values, read_table(spark, sf_dir, "part").select(F.lit("part").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("records")))


@query("profile_attributes", f"""with {VALUES}, n as (select count(*) as records from part)
select source_id, attribute, count(*) as non_null, count(*) / max(records)::double as non_null_rate, count(distinct value) as cardinality, count(distinct value) / count(*)::double as uniqueness_rate,
  min(length(value)) as length_min, avg(length(value)) as length_avg, max(length(value)) as length_max, min(case when attribute in ('price', 'size') then value::double end) as number_min,
  round(avg(case when attribute in ('price', 'size') then value::double end), 6) as number_avg, max(case when attribute in ('price', 'size') then value::double end) as number_max from v, n group by 1, 2""")
def profile_attributes(spark, sf_dir):
    return profiles(spark, sf_dir).select("source_id", "attribute", "non_null", "non_null_rate", "cardinality", "uniqueness_rate", F.col("length_min").cast("long").alias("length_min"), "length_avg", F.col("length_max").cast("long").alias("length_max"), "number_min", F.round("number_avg", 6).alias("number_avg"), "number_max")


@query("profile_values", f"""with {VALUES}, c as (select attribute, value, count(*) as n, min(ord) as o from v group by all), r as (select *, row_number() over (partition by attribute order by n desc, o, value) as k from c),
s as (select *, row_number() over (partition by attribute order by ord, value) as k from v)
select attribute, (select string_agg(value, '|' order by k) from r where r.attribute = a.attribute and k <= 5) as frequent_values, (select string_agg(value, '|' order by k) from s where s.attribute = a.attribute and k <= 5) as sample_values from (select distinct attribute from v) a""")
def profile_values(spark, sf_dir):
    return profiles(spark, sf_dir).select("attribute", F.array_join("frequent_values", "|").alias("frequent_values"), F.array_join("sample_values", "|").alias("sample_values"))


@query("token_patterns", f"""with {VALUES} select attribute, count(*) filter (regexp_matches(value, '(?i)\\b[A-Z]{{1,5}}[- ]?[0-9]{{2,5}}[A-Z0-9-]*\\b')) as has_model_like_token, count(*) filter (regexp_matches(value, '[0-9]')) as has_number,
  count(*) filter (regexp_matches(value, '(?i)\\b(mm|cm|inch|inches|kg|g|gb|tb|hz|mp|mah|w)\\b')) as has_unit, count(*) filter (regexp_matches(value, '(?i)([$€£]|usd|eur|gbp)\\b')) as has_currency, count(*) filter (regexp_matches(value, '(?i)^https?://')) as has_url from v group by 1""")
def token_patterns(spark, sf_dir):
    return profiles(spark, sf_dir).select("attribute", *profile.PATTERNS)


@query("type_inference", """select * from (values ('brand', 'string', 'brand'), ('product name', 'string', 'title'), ('price', 'number', 'price'), ('size', 'number', 'specification'), ('category', 'string', 'category')) t(attribute, inferred_type, roles)""")
def type_inference(spark, sf_dir):
    return profiles(spark, sf_dir).select("attribute", "inferred_type", F.array_join("semantic_roles", "|").alias("roles"))


@query("schema_heterogeneity", """with s as (select p_brand as source_id, list_sort(list(distinct lower(p_name))) as names from part group by 1)
select round(avg(1 - len(list_intersect(a.names, b.names))::double / len(list_distinct(list_concat(a.names, b.names)))), 9) as schema_heterogeneity from s a join s b on a.source_id < b.source_id""")
def schema_heterogeneity(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), F.col("p_name").alias("attribute"))
    return profile.heterogeneity(p).select(F.round("schema_heterogeneity", 9).alias("schema_heterogeneity"))


@query("fusion_conflicts", """select cast(o_custkey as varchar) as entity_id, 'priority' as attribute, count(distinct lower(trim(o_orderpriority))) as "values" from orders group by 1 having count(distinct lower(trim(o_orderpriority))) > 1""")
def fusion_conflicts(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return profile.fusion_conflicts(o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("Priority").alias("attribute"), F.col("o_orderpriority").alias("value")))


@query("gold_summary", """select count(*) as entities, cast(sum(n) as bigint) as labelled, cast(sum(n * (n - 1) // 2) as bigint) as positive_pairs, sum(case when n > 1 then n else 0 end) / sum(n)::double as overlap_score from (select o_custkey, count(*) as n from orders group by 1)""")
def gold_summary(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return profile.gold_summary(o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderkey").cast("string").alias("spec_id")))


@query("selection_score", """with s as (select (select count(distinct p_brand) from part) as source_count, (select count(*) from part) as record_count, (select count(distinct o_custkey) from orders) as entity_count, (select sum(n * (n - 1) // 2) from (select count(*) as n from orders group by o_custkey)) as positive_pairs)
select round(least(source_count / 8, 1) * 10 + least(record_count / 25000, 1) * 10 + least(entity_count / 500, 1) * 15 + least(positive_pairs / 500, 1) * 15 + least(5 / 8, 1) * 15 + 5 + 5 + 5 * 0.5 + 5 + 5 * 0.25, 4) as score,
  source_count >= 3 and record_count >= 1000 and entity_count >= 200 and positive_pairs >= 300 as passes from s""")
def selection_score(spark, sf_dir):
    p, o = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "orders")
    pairs = o.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("entity_count"), F.sum(F.expr("n * (n - 1) div 2")).alias("positive_pairs"))
    row = p.agg(F.countDistinct("p_brand").alias("source_count"), F.count("*").alias("record_count")).join(pairs, F.lit(True))
    m = {c: F.col(c) for c in row.columns} | {"mediated_coverage": F.lit(5), "schema_heterogeneity": F.lit(0.5), "overlap_score": F.lit(0.5), "model_number_coverage": F.lit(0.5), "title_signal_coverage": F.lit(1.0), "fusion_conflicts": F.lit(50)}
    return row.select(profile.selection_score(m).alias("score"), profile.gate(m | {"fusion_conflicts": F.lit(100)}).alias("passes"))


# --- values and text


@query("norm_price", """with r as (select p_partkey, case p_partkey % 5 when 0 then '$' || p_retailprice when 1 then 'EUR ' || replace(cast(p_retailprice as varchar), '.', ',') when 2 then 'ask us' when 3 then '£' || p_size else p_size || ' USD' end as raw from part)
select p_partkey, case when p_partkey % 5 = 2 then 'ask us' when p_partkey % 5 in (0, 1) then printf('%.2f', p_retailprice) else printf('%.2f', p_size::double) end as amount, case p_partkey % 5 when 0 then 'USD' when 1 then 'EUR' when 3 then 'GBP' when 4 then '' end as currency from r join part using (p_partkey)""")
def norm_price(spark, sf_dir):
    m = F.col("p_partkey") % 5
    price = F.col("p_retailprice").cast("string")
    raw = F.when(m == 0, F.concat(F.lit("$"), price)).when(m == 1, F.concat(F.lit("EUR "), F.replace(price, F.lit("."), F.lit(",")))).when(m == 2, "ask us").when(m == 3, F.concat(F.lit("£"), "p_size")).otherwise(F.concat("p_size", F.lit(" USD")))
    return read_table(spark, sf_dir, "part").select("p_partkey", V.price(raw).alias("x")).select("p_partkey", "x.*")


@query("norm_measurement", """select p_partkey, case p_partkey % 6 when 2 then cast(p_size * 1024 as varchar) when 4 then null else cast(p_size as varchar) end as value, case p_partkey % 6 when 0 then 'inch' when 1 then 'MP' when 2 then 'GB' when 3 then 'px' when 5 then '' end as unit from part""")
def norm_measurement(spark, sf_dir):
    m = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    raw = F.when(m == 0, F.concat(size, F.lit("″"))).when(m == 1, F.concat(size, F.lit(" Megapixels"))).when(m == 2, F.concat(size, F.lit("TB"))).otherwise(size)
    name = F.when(m == 3, "Native Resolution").when(m == 4, "colour").when(m == 5, "weight").otherwise("x")
    return read_table(spark, sf_dir, "part").select("p_partkey", V.measurement(raw, name).alias("x")).select("p_partkey", "x.value", "x.unit")


@query("norm_names", f"""select p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-' || p_type, '[a-zA-Z]+|[^a-zA-Z]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '') as brand,
  {sql_model("p_brand || ' ' || p_size || '/d'")} as model_number, array_to_string({sql_words("p_name || '__' || p_type || ' ' || p_name")}, '_') as spec_key,
  case p_partkey % 4 when 0 then 'mirrorless camera' when 1 then 'dslr camera' when 2 then 'monitor' else lower(p_type) || ' x' end as category,
  case p_partkey % 3 when 0 then 'true' when 1 then 'false' else lower(p_type) end as flag from part""")
def norm_names(spark, sf_dir):
    c = F.col
    m = c("p_partkey") % 4
    category = F.when(m == 0, "A  Mirrorless DSLR").when(m == 1, "D-SLR camera").when(m == 2, "LCD Display").otherwise(F.concat("p_type", F.lit("  x ")))
    flag = F.when(c("p_partkey") % 3 == 0, " YES ").when(c("p_partkey") % 3 == 1, "n").otherwise(c("p_type"))
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", V.brand(F.concat_ws("-", "p_name", "p_type")).alias("brand"), T.model_number(F.concat("p_brand", F.lit(" "), "p_size", F.lit("/d"))).alias("model_number"), T.spec_key(F.concat("p_name", F.lit("__"), "p_type", F.lit(" "), "p_name")).alias("spec_key"), V.category(category).alias("category"), V.boolean(flag).alias("flag"))


@query("normalize_value", """select p_partkey, case p_partkey % 4 when 0 then upper(replace(p_brand, '#', '')) when 1 then printf('%.2f', p_retailprice) when 2 then cast(p_size as varchar) else lower(p_type) end as value,
  case p_partkey % 4 when 1 then 'USD' when 2 then 'inch' end as unit, case p_partkey % 4 when 0 then 'model_number' when 1 then 'price_decimal' when 2 then 'measurement_parse' else 'normalized_text' end as method,
  case p_partkey % 4 when 0 then 0.95 when 1 then 0.9 when 2 then 0.88 else 0.8 end::double as confidence from part""")
def normalize_value(spark, sf_dir):
    m = F.col("p_partkey") % 4
    target = F.when(m == 0, "model_number").when(m == 1, "Price").when(m == 2, "screen_size_diagonal").otherwise("color")
    raw = F.when(m == 0, F.col("p_brand")).when(m == 1, F.concat(F.lit(" $ "), F.col("p_retailprice").cast("string"))).when(m == 2, F.concat("p_size", F.lit(" in"))).otherwise(F.col("p_type"))
    return read_table(spark, sf_dir, "part").select("p_partkey", V.normalize_value(target, raw, F.lit("")).alias("x")).select("p_partkey", "x.*")


@query("document_tokens", f"""select doc_id, len({sql_tokens("text")}) as n_tokens, md5(array_to_string({sql_tokens("text")}, ' ')) as tokens_md5, len({sql_informative("text")}) as n_informative from documents""")
def document_tokens(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), F.col("text"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ").cast("binary")).alias("tokens_md5"), F.size(T.informative_tokens(F.col("text"))).cast("long").alias("n_informative"))


@query("name_similarity", f"""with a as (select p_partkey, p_name, lead(p_name) over (order by p_partkey) as other from part), s as (select p_partkey, {sql_jaccard(sql_tokens("p_name"), sql_tokens("other"))} as token_jaccard,
  {sql_jaccard(f"list_distinct({sql_qgrams('lower(p_name)')})", f"list_distinct({sql_qgrams('lower(other)')})")} as char_similarity, p_name = other as same from a where other is not null)
select p_partkey, round(token_jaccard, 9) as token_jaccard, round(char_similarity, 9) as char_similarity, round(case when same then 1.0 else greatest(token_jaccard, 0.85 * char_similarity) end, 9) as name_similarity from s""")
def name_similarity(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    a, b = F.col("p_name"), F.col("other")
    return pairs.select("p_partkey", *[F.round(x, 9).alias(n) for n, x in (("token_jaccard", T.jaccard(T.tokens(a), T.tokens(b))), ("char_similarity", T.char_similarity(a, b)), ("name_similarity", T.name_similarity(a, b)))])


@query("model_tokens", f"""select p_partkey, array_to_string({sql_model_tokens("'EOS-' || p_size || '00D, ' || p_name")}, ',') as model_tokens from part""")
def model_tokens(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", joined(T.model_tokens(F.concat(F.lit("EOS-"), "p_size", F.lit("00D, "), "p_name"))).alias("model_tokens"))


# --- blocking and matching

BLOCKS = blocking.BlockingConfig(max_block_size=120)
KEYS = f"""{PRODUCTS},
df as (select t as token, count(*) as df from (select unnest({sql_informative("title")}) as t from products) group by 1),
rare as (select uid, lower(category) as category, t as token from (select uid, category, unnest(list_slice({sql_informative("title")}, 1, 6)) as t from products) x join df on df.token = x.t where df.df <= 80),
keys as (select distinct * from (
  select uid, 'brand_model' as rule, lower(brand) || '|' || {sql_model("model_number")} as key from products
  union all select uid, 'rare_model_token', unnest({sql_model_tokens("model_number || ' ' || title")}) from products
  union all select uid, 'rare_title_token', token from rare
  union all select uid, 'category_title_token', category || '|' || token from rare
  union all select uid, 'character_signature', unnest(list_slice({sql_qgrams("array_to_string(" + sql_tokens("title") + ", '')")}, 1, 4)) from products
  union all select uid, 'spec_signature', lower(brand) || '|screen|' || screen from products)),
sizes as (select rule, key, count(*) as block_size from keys group by all),
pairs as (select l.uid as left_uid, r.uid as right_uid, list_sort(list(distinct l.rule)) as rules from keys l join keys r on l.rule = r.rule and l.key = r.key and l.uid < r.uid join sizes s on s.rule = l.rule and s.key = l.key where s.block_size <= 120 group by all)"""


@query("block_keys", f"with {KEYS} select uid, rule, key from keys")
def block_keys(spark, sf_dir):
    return blocking.blocking_keys(products(spark, sf_dir), BLOCKS)


@query("block_sizes", f"with {KEYS} select rule, count(*) as blocks, max(block_size) as largest, count(*) filter (block_size > 120) as oversized from sizes group by 1")
def block_sizes(spark, sf_dir):
    sizes = blocking.block_sizes(blocking.blocking_keys(products(spark, sf_dir), BLOCKS))
    return sizes.groupBy("rule").agg(F.count("*").alias("blocks"), F.max("block_size").alias("largest"), F.sum((F.col("block_size") > 120).cast("long")).alias("oversized"))


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidate_pairs(blocking.blocking_keys(products(spark, sf_dir), BLOCKS), BLOCKS, blocking.RULES)


@query("candidate_pairs", f"with {KEYS} select left_uid, right_uid, array_to_string(rules, ',') as rules, len(rules) as blocking_score from pairs")
def candidate_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir).withColumn("rules", F.array_join("rules", ",")).withColumn("blocking_score", F.col("blocking_score").cast("long"))


@query("numbered_pairs", f"with {KEYS} select 'pair_' || lpad(cast(row_number() over (order by left_uid, right_uid) as varchar), 8, '0') as pair_id, left_uid, right_uid from pairs")
def numbered_pairs(spark, sf_dir):
    return blocking.number_pairs(pairs_of(spark, sf_dir)).select("pair_id", "left_uid", "right_uid")


@query("blocking_metrics", f"""with {KEYS}, truth as (select l.uid as left_uid, r.uid as right_uid from products l join products r on l.title = r.title and l.brand = r.brand and l.uid < r.uid),
c as (select (select count(*) from products) as records, (select count(*) from pairs) as candidate_pairs, (select sum(len(rules)) from pairs) as emitted, (select count(*) from sizes where block_size > 120) as oversized_blocks, (select count(*) from truth) as t, (select count(*) from truth join pairs using (left_uid, right_uid)) as f)
select records, candidate_pairs, oversized_blocks, round(f / t::double, 9) as pair_completeness, round(1 - candidate_pairs / (records * (records - 1) / 2), 9) as reduction_ratio, round(candidate_pairs / records::double, 9) as candidates_per_record, round(1 - candidate_pairs / emitted::double, 9) as duplicate_rate from c""")
def blocking_metrics(spark, sf_dir):
    p = products(spark, sf_dir)
    keys = blocking.blocking_keys(p, BLOCKS)
    same = F.when(F.col("title").isNotNull() & F.col("brand").isNotNull(), F.struct("title", "brand"))
    m = blocking.blocking_metrics(p, keys, blocking.candidate_pairs(keys, BLOCKS, blocking.RULES), p.select("uid", same.alias("entity")), BLOCKS)
    return m.select("records", "candidate_pairs", "oversized_blocks", *[F.round(c, 9).alias(c) for c in ("pair_completeness", "reduction_ratio", "candidates_per_record", "duplicate_rate")])


def features_of(spark: SparkSession, sf_dir: str, **carried: Column) -> DataFrame:
    return matching.pair_features(pairs_of(spark, sf_dir), products(spark, sf_dir).withColumns(carried), tuple(carried))


def sql_pair(f: str) -> tuple[str, str]:
    return f"l.{f}", f"r.{f}"


FEATURES = f"""{KEYS}, f as (select left_uid, right_uid, {sql_jaccard(sql_tokens("l.title"), sql_tokens("r.title"))} as title_token_jaccard,
  {sql_jaccard(f"list_distinct({sql_qgrams('lower(l.title)')})", f"list_distinct({sql_qgrams('lower(r.title)')})")} as title_char_similarity,
  (l.brand = r.brand)::int::double as brand_exact, (l.brand <> r.brand)::int::double as brand_conflict, ({sql_model("l.model_number")} = {sql_model("r.model_number")})::int::double as model_exact,
  {sql_jaccard(sql_model_tokens(sql_model("l.model_number")), sql_model_tokens(sql_model("r.model_number")))} as model_token_overlap, ({sql_model("l.model_number")} <> {sql_model("r.model_number")})::int::double as model_conflict,
  (l.category = r.category)::int::double as category_exact, greatest(0, 1 - abs(l.price::double - r.price::double) / greatest(l.price::double, r.price::double, 1.0)) as price_relative_similarity,
  {sql_jaccard("l.spec_keys", "r.spec_keys")} as spec_key_jaccard, len(rules)::double as blocking_rule_count, (l.source_id = r.source_id)::int::double as same_source
  from pairs join products l on l.uid = left_uid join products r on r.uid = right_uid),
scored as (select *, case when brand_conflict > 0 or model_conflict > 0 then 0.05 when model_exact > 0 and (brand_exact > 0 or title_token_jaccard > 0.25) then 0.95 when brand_exact > 0 and title_token_jaccard > 0.5 then 0.8
  when title_token_jaccard > 0.65 and spec_key_jaccard > 0.2 then 0.7 else greatest(0.05, least(0.6, 0.7 * title_token_jaccard + 0.2 * spec_key_jaccard)) end::double as rule_score from f)"""


@query("pair_features", f"with {FEATURES} select left_uid, right_uid, " + ", ".join(f"round({f}, 9) as {f}" for f in matching.FEATURES) + ", rule_score from scored")
def pair_features(spark, sf_dir):
    return features_of(spark, sf_dir).select("left_uid", "right_uid", *[F.round(f, 9).alias(f) for f in matching.FEATURES], matching.rule_score().alias("rule_score"))


SPLIT = "case when cast('0x' || substr(sha256('13|' || {0}), 1, 8) as bigint) % 100 < 60 then 'train' when cast('0x' || substr(sha256('13|' || {0}), 1, 8) as bigint) % 100 < 80 then 'validation' else 'test' end"


@query("split_assignment", f"select c_custkey, {SPLIT.format('c_name')} as split from customer")
def split_assignment(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", matching.split_of(F.col("c_name"), F.col("c_custkey").cast("string")).alias("split"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.concat_ws("|", "brand", "title")
    f = features_of(spark, sf_dir, gold=entity, split=matching.split_of(entity, F.col("uid")))
    return f.withColumn("label", matching.pair_label(F.col("left_gold"), F.col("right_gold"))).withColumn("split", matching.pair_split(F.col("left_split"), F.col("right_split")))


LABELLED = f"""{FEATURES}, g as (select uid, brand || '|' || title as e, {SPLIT.format("brand || '|' || title")} as split from products),
labelled as (select s.*, (a.e = b.e)::int as label, case when a.split = b.split then a.split else 'heldout_cross_split' end as split from scored s join g a on a.uid = left_uid join g b on b.uid = right_uid)"""


@query("threshold_calibration", f"""with {LABELLED}, t as (select unnest([{", ".join(map(str, matching.GRID))}])::double as threshold), c as (select threshold, sum((rule_score >= threshold and label = 1)::int) as tp, sum((rule_score >= threshold and label = 0)::int) as fp, sum((rule_score < threshold and label = 1)::int) as fn from labelled, t where split = 'validation' group by 1),
p as (select threshold, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from c), x as (select threshold, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from p)
select coalesce((select threshold from x order by f1 desc, threshold limit 1), 0.5) as threshold, round(coalesce((select max(f1) from x), 0), 9) as f1""")
def threshold_calibration(spark, sf_dir):
    scored = labelled_pairs(spark, sf_dir).withColumn("match_probability", matching.rule_score())
    return matching.calibrate(scored).select("threshold", F.round("f1", 9).alias("f1"))


@query("pair_metrics", f"""with {LABELLED}, s(split) as (values ('train'), ('validation'), ('test'), ('heldout_cross_split')), c as (select split, count(*) filter (label = 1 and rule_score >= 0.5) as tp, count(*) filter (label = 0 and rule_score >= 0.5) as fp, count(*) filter (label = 0 and rule_score < 0.5) as tn, count(*) filter (label = 1 and rule_score < 0.5) as fn from s left join labelled using (split) group by 1),
p as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as recall from c)
select *, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from p""")
def pair_metrics(spark, sf_dir):
    rows = labelled_pairs(spark, sf_dir).select("split", "label", (matching.rule_score() >= 0.5).cast("int").alias("prediction"))
    return matching.classification_metrics(rows).withColumn("f1", F.round("f1", 9))


@query("match_model")
def match_model(spark, sf_dir):
    return matching.match_model(cut_lineage(labelled_pairs(spark, sf_dir))).select("left_uid", "right_uid", "match_probability", "model_status")


# --- clustering


@query("connected_components", """select doc_id as id, min(doc_id) over (partition by text) as component from documents qualify count(*) over (partition by text) > 1""")
def connected_components(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    from pyspark.sql.window import Window

    chain = d.withColumn("dst", F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).filter("dst is not null")
    return components.connected_components(chain, "doc_id", "dst")


def brand_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = products(spark, sf_dir)
    roots = p.groupBy("brand", "title").agg(F.min("uid").alias("cluster_root"))
    return p.join(roots, ["brand", "title"]).select("uid", "cluster_root"), p, p.select("uid", F.concat_ws("|", "brand", "category").alias("gold_entity"))


MEMBERS = f"{PRODUCTS}, m as (select uid, source_id, brand || '|' || category as gold, min(uid) over (partition by brand, title) as cluster_root from products)"


@query("cluster_rows", f"""with {MEMBERS}, t as (select cluster_root, gold, row_number() over (partition by cluster_root order by count(*) desc, gold) as k from m group by 1, 2)
select cluster_root, 'entity_' || lpad(cast(row_number() over (order by cluster_root) as varchar), 6, '0') as entity_id, min(uid) as first_uid, count(*) as size, count(distinct source_id) as sources, round(least(1.0, 0.45 + 0.1 * (count(*) - 1)), 9)::double as confidence, max(t.gold) as primary_truth from m join t using (cluster_root) where t.k = 1 group by cluster_root""")
def cluster_rows(spark, sf_dir):
    return clustering.cluster_rows(*brand_clusters(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query("cluster_pair_metrics", f"""with {MEMBERS}, a as (select (select sum(n * (n - 1) // 2) from (select count(*) as n from m group by cluster_root, gold))::bigint as tp, (select sum(n * (n - 1) // 2) from (select count(*) as n from m group by cluster_root))::bigint as predicted, (select sum(n * (n - 1) // 2) from (select count(*) as n from m group by gold))::bigint as wanted)
select *, case when predicted > 0 then tp / predicted::double else 0 end as precision, case when wanted > 0 then tp / wanted::double else 0 end as recall, round(case when predicted + wanted > 0 then 2 * tp / (predicted + wanted)::double else 0 end, 9) as f1 from a""")
def cluster_pair_metrics(spark, sf_dir):
    members, _, truth = brand_clusters(spark, sf_dir)
    return clustering.cluster_pair_metrics(members, truth).withColumn("f1", F.round("f1", 9))


@query("largest_clusters", f"with {MEMBERS} select cluster_root, count(*) as size from m group by 1 order by size desc, cluster_root limit 25")
def largest_clusters(spark, sf_dir):
    return brand_clusters(spark, sf_dir)[0].groupBy("cluster_root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_root").limit(25)


@query("constrained_clusters")
def constrained_clusters(spark, sf_dir):
    edges = features_of(spark, sf_dir).select("left_uid", "right_uid", matching.rule_score().alias("match_probability"))
    return clustering.constrained_clusters(products(spark, sf_dir), edges, clustering.ClusterConfig(same_source=False))[0]


# --- claims and fusion


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    pairs = F.array(F.struct(F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value"), F.lit("").alias("unit")), F.struct(F.lit("total").alias("attribute"), F.col("o_totalprice").cast("string").alias("value"), F.lit("usd").alias("unit")))
    rows = o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderkey").alias("ord"), F.explode(pairs).alias("x")).select("entity_id", "ord", "x.*")
    return rows.withColumn("claim_id", V.content_id("claim_", 20, F.col("attribute"), F.col("ord").cast("string")))


CLAIMS = """c as (select cast(o_custkey as varchar) as entity_id, o_orderkey as ord, u.attribute, u.value, u.unit, 'claim_' || substr(sha256(u.attribute || '|' || o_orderkey), 1, 20) as claim_id from (select *, unnest([{attribute: 'priority', value: o_orderpriority, unit: ''}, {attribute: 'total', value: cast(o_totalprice as varchar), unit: 'usd'}]) as u from orders)),
v as (select entity_id, attribute, value, count(*) as n, min(ord) as o from c group by all), med as (select entity_id, median(value::double) as middle from c where attribute = 'total' group by 1),
r as (select v.*, row_number() over (partition by v.entity_id, attribute order by case when attribute = 'priority' then -n::double else abs(value::double - middle) end, o) as k from v left join med on v.entity_id = med.entity_id and attribute = 'total'),
fused as (select c.entity_id, c.attribute, max(r.value) as selected_value, case c.attribute when 'priority' then 'majority_vote' else 'numeric_median' end as fusion_method, avg((c.value = r.value)::int) as confidence, count(*) as claims,
  coalesce(string_agg(case when c.value = r.value then claim_id end, ',' order by claim_id), '') as supporting, coalesce(string_agg(case when c.value <> r.value then claim_id end, ',' order by claim_id), '') as contradicting, array_to_string(list_sort(list(distinct c.value)), ',') as alternatives, count(distinct c.value) as kinds from c join r on r.entity_id = c.entity_id and r.attribute = c.attribute and r.k = 1 group by 1, 2)"""


@query("claims", f"with {CLAIMS} select claim_id, entity_id, attribute, value, unit from c")
def claims(spark, sf_dir):
    return order_claims(spark, sf_dir).select("claim_id", "entity_id", "attribute", "value", "unit")


@query("fused_values", f"with {CLAIMS} select entity_id, attribute, selected_value, fusion_method, round(confidence, 9) as confidence, claims, supporting, contradicting, alternatives, case attribute when 'total' then 'usd' end as selected_unit from fused")
def fused_values(spark, sf_dir):
    f = fusion.fuse(order_claims(spark, sf_dir))
    return f.select("entity_id", "attribute", "selected_value", "fusion_method", F.round("confidence", 9).alias("confidence"), "claims", F.array_join("supporting_claim_ids", ",").alias("supporting"), F.array_join("contradicting_claim_ids", ",").alias("contradicting"), F.array_join("alternative_values", ",").alias("alternatives"), "selected_unit")


@query("fused_text", f"""with v as (select p_brand as entity_id, p_name as value, count(*) as n from part group by all), s as (select a.entity_id, a.value, a.n, round(avg({sql_jaccard(f"list_distinct({sql_qgrams('lower(a.value)')})", f"list_distinct({sql_qgrams('lower(b.value)')})")}), 9) as score from v a join v b on a.entity_id = b.entity_id and a.value <> b.value group by all),
k as (select entity_id, count(*) as kinds from v group by 1), r as (select s.entity_id, value, row_number() over (partition by s.entity_id order by score desc, length(value) desc, n desc, value) as r from s join k using (entity_id) where kinds <= 50 union all select v.entity_id, value, row_number() over (partition by v.entity_id order by n desc, length(value) desc, value) from v join k using (entity_id) where kinds > 50 or kinds = 1)
select entity_id, value as selected_value from r where r = 1""")
def fused_text(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity_id"), F.lit("title").alias("attribute"), F.col("p_partkey").cast("string").alias("claim_id"), F.col("p_name").alias("value"), F.lit(None).cast("string").alias("unit"), F.col("p_partkey").alias("ord"))
    return fusion.fuse(p).select("entity_id", "selected_value")


@query("integrated_entities", f"""with {CLAIMS} select entity_id, '{{' || string_agg('"' || attribute || '":"' || selected_value || '"', ',' order by attribute) || '}}' as canonical_payload from fused group by 1 union all select cast(c_custkey as varchar), '{{}}' from customer where c_custkey not in (select o_custkey from orders)""")
def integrated_entities(spark, sf_dir):
    entities = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    return fusion.integrated_entities(fusion.fuse(order_claims(spark, sf_dir)), entities).select("entity_id", "canonical_payload")


@query("fusion_errors", f"with {CLAIMS} select attribute, count(*) filter (kinds >= 4) as high_conflict, count(*) filter (kinds > 1 or confidence < 0.67) as low_support, count(*) filter (lower(trim(selected_value)) in ('', 'no info', 'unknown', 'n/a', 'none')) as unsupported from fused group by 1")
def fusion_errors(spark, sf_dir):
    f = fusion.fuse(order_claims(spark, sf_dir))
    n = lambda ok, name: F.count(F.when(ok, 1)).alias(name)
    return f.groupBy("attribute").agg(n(fusion.is_high_conflict(), "high_conflict"), n(fusion.is_low_support(), "low_support"), n(fusion.is_unsupported(), "unsupported"))


@query("fusion_accuracy", f"with {CLAIMS} select count(*) as evaluated, sum((selected_value = '1-URGENT')::int)::bigint as correct, avg((selected_value = '1-URGENT')::int) as accuracy from fused where attribute = 'priority'")
def fusion_accuracy(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    gold = o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit("priority").alias("attribute"), F.lit(" 1-Urgent").alias("truth")).distinct()
    primary = o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("primary_truth")).limit(0)
    return fusion.fusion_accuracy(fusion.fuse(order_claims(spark, sf_dir)), gold, primary)


# --- routing


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("route_ord"), F.col("event_id").cast("string").alias("case_id"), F.col("event_type").alias("stage"), (F.pmod("event_id", F.lit(101)) / 100).alias("match_probability"), F.col("props").alias("payload"), (F.length("props") / 1000).alias("estimated_cost"))


CASES = "cases as (select event_id as route_ord, cast(event_id as varchar) as case_id, event_type as stage, (event_id % 101) / 100.0::double as match_probability, props as payload, length(props) / 1000.0::double as estimated_cost from events)"


@query("route_linkage", f"with {CASES} select case_id, match_probability from cases where match_probability between 0.35 and 0.75")
def route_linkage(spark, sf_dir):
    return routing.route_linkage(cases(spark, sf_dir)).select("case_id", "match_probability")


@query("budget_gate", f"""with {CASES}, a as (select *, row_number() over (partition by stage order by route_ord) as s from cases), b as (select *, sum((s <= 25)::int) over (order by route_ord) + 3 as r from a)
select case_id, s <= 25 and r <= 50 as selected, case when s > 25 then 'stage_cap' when r > 50 then 'run_call_cap' else 'selected' end as reason from b""")
def budget_gate(spark, sf_dir):
    return routing.budget_gate(cases(spark, sf_dir), 25, 50, used=3).select("case_id", "selected", "reason")


@query("case_batches", f"with {CASES}, t as (select * from cases order by match_probability desc, route_ord limit 95), r as (select case_id, row_number() over (order by match_probability desc, route_ord) - 1 as k from t) select case_id, cast(k // 10 as int) as batch_id, cast(k % 10 as int) as batch_index from r")
def case_batches(spark, sf_dir):
    order = (F.desc("match_probability"), F.col("route_ord"))
    return routing.batches(routing.top_cases(cases(spark, sf_dir), 95, *order), 10, *order).select("case_id", "batch_id", "batch_index")


@query("request_estimate", f"with {CASES} select case_id, cast(ceil(length(payload) / 4.0) as bigint) as input_tokens, 1024::bigint as output_tokens, round((ceil(length(payload) / 4.0) * 0.4 + 1024 * 1.6) / 1e6, 12) as cost from cases")
def request_estimate(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", routing.estimate(F.col("payload"), 1024, 0.4, 1.6).alias("x")).select("case_id", "x.input_tokens", "x.output_tokens", F.round("x.cost", 12).alias("cost"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).withColumn("answer", routing.linkage_answer(F.col("match_probability")))
    valid, abstains = F.col("route_ord") % 11 != 0, F.col("route_ord") % 13 == 0
    reason = routing.fallback_decision(valid, abstains, F.lit(True), F.col("answer.confidence"), 0.72)
    return routing.apply_decisions(c, F.when(F.col("match_probability") >= 0.6, "match").otherwise("non_match"), F.col("answer.decision"), reason)


DECIDED = f"""{CASES}, d as (select *, case when route_ord % 11 = 0 then 'invalid_response' when route_ord % 13 = 0 then 'abstained' when round(0.6 + abs(match_probability - 0.5) * 0.8, 6) < 0.72 then 'low_confidence' end as fallback_reason from cases),
e as (select *, case when fallback_reason is null then case when match_probability >= 0.5 then 'match' else 'non_match' end else case when match_probability >= 0.6 then 'match' else 'non_match' end end as final from d)"""


@query("decision_apply", f"with {DECIDED} select case_id, fallback_reason, final, fallback_reason is null as accepted from e")
def decision_apply(spark, sf_dir):
    return decided(spark, sf_dir).select("case_id", "fallback_reason", "final", "accepted")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir).filter(F.col("match_probability").between(0.35, 0.75))
    truth = F.when(F.col("route_ord") % 3 == 0, "match").otherwise("non_match")
    return d.select("route_ord", "stage", F.lit(True).alias("selected"), "accepted", F.length("payload").alias("input_tokens"), F.lit(10).alias("output_tokens"), (F.length("payload") / 1024).alias("cost"), (F.when(F.col("match_probability") >= 0.6, "match").otherwise("non_match") == truth).alias("before_correct"), (F.col("final") == truth).alias("after_correct"))


ROUTES = f"""{DECIDED}, routes as (select route_ord, stage, fallback_reason is null as accepted, length(payload) as input_tokens, 10 as output_tokens, length(payload) / 1024.0::double as cost,
  case when match_probability >= 0.6 then 'match' else 'non_match' end = case when route_ord % 3 = 0 then 'match' else 'non_match' end as before_correct, final = case when route_ord % 3 = 0 then 'match' else 'non_match' end as after_correct from e where match_probability between 0.35 and 0.75)"""


@query("quality_cost", f"""with {ROUTES}, q as (select stage, count(*) as cases, count(*) as selected, sum(accepted::int)::bigint as accepted, sum((not accepted)::int)::bigint as fallbacks, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cost) as cost, sum(before_correct::int)::bigint as before_correct, sum(after_correct::int)::bigint as after_correct from routes group by 1)
select *, round(fallbacks / selected::double, 9) as fallback_rate, round((after_correct - before_correct) / cases::double, 9) as gain from q""")
def quality_cost(spark, sf_dir):
    return routing.quality_cost(routes(spark, sf_dir)).withColumn("fallback_rate", F.round("fallback_rate", 9)).withColumn("gain", F.round("gain", 9))


@query("quality_frontier", f"""with {ROUTES}, r as (select row_number() over w as budget, sum(cost) over w as cost, sum(after_correct::int - before_correct::int) over w as g from routes window w as (order by route_ord rows unbounded preceding))
select budget, cost, (g + (select sum(before_correct::int) from routes))::bigint as correct from r union all select 0, 0.0, (select sum(before_correct::int) from routes)::bigint""")
def quality_frontier(spark, sf_dir):
    return routing.frontier(routes(spark, sf_dir)).withColumn("budget", F.col("budget").cast("long"))


@query("operational_rollup", """with r as (select event_type, count(*) as selected, sum((value > 10)::int) as accepted, sum(length(props)) / 1024.0::double as cost, round(max(value), 3) as latency_ms from events group by 1)
select sum(selected)::bigint as selected, sum(accepted)::bigint as accepted, sum(cost) as cost, round(sum(latency_ms * selected) / sum(selected), 6) as average_latency_ms from r""")
def operational_rollup(spark, sf_dir):
    r = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("selected"), F.sum((F.col("value") > 10).cast("int")).alias("accepted"), (F.sum(F.length("props")) / 1024).alias("cost"), F.round(F.max("value"), 3).alias("latency_ms"))
    return routing.operational_rollup(r).withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query("batch_validation", f"""with {CASES}, x as (select case_id, cast(route_ord // 10 as int) as batch_id, route_ord % 29 as m from cases)
select batch_id, case_id, 'missing' as problem from x where m = 0 union all select batch_id, case_id, 'duplicate' from x where m = 1 union all select batch_id, case_id || 'x', 'unknown' from x where m = 2""")
def batch_validation(spark, sf_dir):
    c = cases(spark, sf_dir).select("case_id", F.floor(F.col("route_ord") / 10).cast("int").alias("batch_id"), (F.col("route_ord") % 29).alias("m"))
    answers = c.filter("m <> 0").unionByName(c.filter("m = 1")).unionByName(c.filter("m = 2").withColumn("case_id", F.concat("case_id", F.lit("x"))))
    return routing.validate_batches(c, answers)


@query("cached_calls", f"with {CASES} select count(*) as cases, count(distinct stage || payload) as answers from cases")
def cached_calls(spark, sf_dir):
    c = cases(spark, sf_dir)
    cache = c.filter("stage = 'click'").select(F.sha2(F.concat_ws("|", "stage", "payload"), 256).alias("input_hash"), F.concat("stage", "payload").alias("response")).distinct()
    out = routing.cached_calls(c, cache, lambda stage, payload: stage + payload)
    return out.agg(F.count("*").alias("cases"), F.countDistinct("response").alias("answers"))


@query("progress_remaining", f"with {CASES} select case_id from cases where route_ord % 4 <> 0")
def progress_remaining(spark, sf_dir):
    c = cases(spark, sf_dir)
    return routing.remaining(c, c.filter("route_ord % 4 = 0").select("case_id")).select("case_id")


# --- subsets and whole runs


@query("subset_entities", """with g as (select cast(l_partkey as varchar) as entity_id, count(distinct l_suppkey) as sources, count(*) as specs from lineitem group by 1)
select entity_id, sources, specs, substr(sha256('13|' || entity_id), 1, 16) as tie from g order by (entity_id in ('1', '2')) desc, sources desc, specs desc, tie, entity_id limit 60""")
def subset_entities(spark, sf_dir):
    return subset.select_entities(lines(spark, sf_dir), 60, required=("1", "2"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_suppkey").alias("source_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("record_id"))


@query("subset_records", """with g as (select l_partkey, count(distinct l_suppkey) as sources, count(*) as specs from lineitem group by 1), c as (select l_partkey from g order by sources desc, specs desc, substr(sha256('13|' || l_partkey), 1, 16) limit 60)
select cast(l_partkey as varchar) as entity_id, l_suppkey as source_id, l_orderkey || '/' || l_linenumber as record_id from lineitem where l_partkey in (select l_partkey from c)""")
def subset_records(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return subset.restrict(rows, subset.select_entities(rows, 60), "entity_id").select("entity_id", "source_id", "record_id")


@query("mapping_metrics", """with g as (select p_partkey as k, p_type as want, case when p_partkey % 5 = 0 then 'UNMAPPED' when p_partkey % 7 = 0 then 'OTHER' else p_type end as got from part), c as (select count(*) filter (got = want) as tp, count(*) filter (got not in ('UNMAPPED', want)) as fp, count(*) filter (got <> want) as fn from g)
select tp, fp, fn, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall, round(2.0 * tp / (2 * tp + fp + fn), 9)::double as f1 from c""")
def mapping_metrics(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").withColumn("source_attribute_id", F.col("p_partkey").cast("string"))
    got = F.when(F.col("p_partkey") % 5 == 0, "UNMAPPED").when(F.col("p_partkey") % 7 == 0, "OTHER").otherwise(F.col("p_type"))
    return schema_align.mapping_metrics(p.select("source_attribute_id", got.alias("target")), p.select("source_attribute_id", F.col("p_type").alias("target"))).withColumn("f1", F.round("f1", 9))


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


def _sql_names(a: str, b: str) -> str:
    grams = lambda x: f"list_distinct({sql_qgrams(f'lower({x})')})"
    same = f"array_to_string({sql_words(a)}, '_') = array_to_string({sql_words(b)}, '_')"
    return f"(case when {same} then 1.0 else greatest({sql_jaccard(sql_tokens(a), sql_tokens(b))}, 0.85 * {sql_jaccard(grams(a), grams(b))}) end)"


_TARGETS = ", ".join(f"('{n}', '{t}', {i}, {_sql_list(schema_align.SYNONYMS.get(n, ()))})" for i, (n, t) in enumerate(schema_align.CORE))
_UNIT = "(?i)\\b(mm|cm|inch|inches|kg|g|gb|tb|hz|mp|mah|w)\\b"
SCHEMA = f"""{VALUES}, n as (select count(*) as records from part),
p as (select attribute, count(*) / max(records)::double as nn, count(distinct value) / count(*)::double as uq, avg(length(value)) as mean_length, bool_and(trim(value) = '' or regexp_matches(trim(value), '^-?[0-9]+([.][0-9]+)?$')) as numbers from v, n group by 1),
f as (select attribute, string_agg(value, ' ' order by ord, value) as j from (select *, row_number() over (partition by attribute order by ord, value) as k from v) where k <= 50 group by 1),
q as (select *, list_distinct(regexp_extract_all(j, '{_UNIT}', 1)) as units, lower(attribute) as a, case when numbers then 'number' when regexp_matches(attribute, '(?i)([$€£]|usd|eur|gbp)\\b') or regexp_matches(j, '(?i)([$€£]|usd|eur|gbp)\\b') then 'currency_or_price' when regexp_matches(j, '(?i)^https?://') then 'url' when regexp_matches(j, '{_UNIT}') then 'measurement' when mean_length > 80 then 'free_text' else 'string' end as kind from p join f using (attribute)),
r as (select *, list_filter([case when contains(a, 'title') or a in ('name', 'product name') then 'title' end, case when regexp_matches(a, 'brand|manufacturer|maker') then 'brand' end, case when contains(a, 'model') or regexp_matches(j, '(?i)\\b[A-Z]{{1,5}}[- ]?[0-9]{{2,5}}[A-Z0-9-]*\\b') then 'model identifier' end,
  case when contains(a, 'price') or regexp_matches(j, '(?i)([$€£]|usd|eur|gbp)\\b') then 'price' end, case when contains(a, 'currency') then 'currency' end, case when regexp_matches(a, 'description|features') then 'description' end, case when regexp_matches(a, 'category|type') then 'category' end,
  case when regexp_matches(j, '{_UNIT}') then 'measurement' end, case when regexp_matches(j, '(?i)^https?://') then 'URL' end], lambda x: x is not null) as found from q),
s as (select *, case when len(found) > 0 then found else ['specification'] end as roles from r),
t(target, target_type, ord, synonyms) as (values {_TARGETS}),
m as (select s.*, t.*, array_to_string({sql_words('attribute')}, '_') = array_to_string({sql_words('target')}, '_') as same_name from s, t),
c as (select attribute, target, ord, same_name,
  case when same_name then 1.0 else greatest({sql_jaccard(sql_tokens('attribute'), sql_tokens('target'))}, coalesce((select max({_sql_names('attribute', 'y.u')}) from (select unnest(synonyms) as u) y), 0)) end as score_name,
  case when target = 'price' then case when kind in ('currency_or_price', 'number') then 1.0 else 0.2 end when target = 'currency' then case when kind = 'currency_or_price' then 1.0 else 0.3 end when target_type in ('decimal', 'number') then case when kind in ('number', 'measurement', 'currency_or_price') then 1.0 else 0.2 end
    when target_type = 'boolean' then case when kind in ('string', 'number') then 0.9 else 0.4 end when target = 'specifications' then 0.8 when kind = 'free_text' and target in ('title', 'description') then 0.8 when kind = 'measurement' and target not in ('title', 'description') then 0.75 else 0.6 end as score_type,
  case when target = 'title' and list_contains(roles, 'title') or target = 'brand' and list_contains(roles, 'brand') then 1.0 when target = 'model_number' and list_contains(roles, 'model identifier') or target = 'price' and (list_contains(roles, 'price') or kind = 'currency_or_price') or target = 'currency' and list_contains(roles, 'currency') then 0.95
    when target = 'description' and list_contains(roles, 'description') or target = 'category' and list_contains(roles, 'category') then 0.9 when target = 'specifications' and (list_contains(roles, 'specification') or len(units) > 0) then 0.75 when regexp_matches(lower(target), '{V.MEASURES}') and len(units) > 0 then 0.8 else 0.35 end as score_value,
  case when target in ('title', 'model_number') then least(1.0, uq * 0.7 + nn * 0.3) when target in ('brand', 'category', 'currency') then least(1.0, (1 - uq) * 0.5 + nn * 0.5) else nn end as score_context
  from m where target <> 'specifications' or len(list_filter(roles, lambda x: contains(x, 'specification') or contains(x, 'measurement'))) > 0),
e as (select attribute, target, ord, score_name * 0.45 + score_type * 0.2 + score_value * 0.25 + score_context * 0.1 as total from c union all select attribute, target, 1048576, 1.0 from m where same_name),
k as (select *, row_number() over (partition by attribute order by round(total, 6) desc, ord) as rank from e)"""


@query("schema_candidates", f"with {SCHEMA} select 'part//' || attribute as source_attribute_id, target, cast(rank as int) as rank, round(total, 6) as score_total from k where rank <= 8")
def schema_candidates(spark, sf_dir):
    return schema_align.rank_candidates(schema_align.score_candidates(part_profiles(spark, sf_dir), schema_align.mediated_schema(spark))).select("source_attribute_id", "target", "rank", F.round("score_total", 6).alias("score_total"))


@query("schema_mappings", f"""with {SCHEMA}, b as (select attribute, max(target) filter (rank = 1) as best, max(total) filter (rank = 1) as one, coalesce(max(total) filter (rank = 2), 0) as two from k group by 1)
select 'part//' || attribute as source_attribute_id, case when round(one, 6) >= 0.58 and round(one - two, 6) >= 0.05 then best else 'UNMAPPED' end as target from b""")
def schema_mappings(spark, sf_dir):
    ranked = schema_align.rank_candidates(schema_align.score_candidates(part_profiles(spark, sf_dir), schema_align.mediated_schema(spark)))
    return schema_align.accept_mappings(ranked).select("source_attribute_id", "target")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    fields = {"product name": "p_name", "maker": "p_brand", "product type": "p_type", "sale price": "p_retailprice", "screen size": "p_size"}
    payload = F.to_json(F.struct(*[F.col(c).cast("string").alias(n) for n, c in fields.items()]))
    source = F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string"))
    return p.select(F.concat_ws(":", source, F.col("p_partkey").cast("string")).alias("record_uid"), source.alias("source_id"), F.col("p_partkey").cast("string").alias("source_record_id"), payload.alias("raw_payload"))


@query("integration_run")
def integration_run(spark, sf_dir):
    return integrate(spark, part_records(spark, sf_dir))["entities"]


# --- provider decisions and reports


@query("linkage_decisions", f"""with {CASES}, a as (select *, case when match_probability >= 0.5 then 1 else 0 end as d, greatest(0.55, least(0.9, abs(match_probability - 0.5) + 0.5)) as conf, case when match_probability >= 0.6 then 1 else 0 end as before from cases)
select case_id, case when route_ord % 17 = 0 then 'invalid_output' when conf < 0.72 then 'low_confidence' end as fallback_reason, case when route_ord % 17 = 0 or conf < 0.72 then before else d end as prediction from a""")
def linkage_decisions(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("response", F.when(F.col("route_ord") % 17 == 0, F.lit('{"decision": "maybe"}')).otherwise(decisions.stand_in("linkage")))
    c = c.withColumn("parsed", decisions.parse(F.col("response"), "linkage")).withColumn("prediction", (F.col("match_probability") >= 0.6).cast("int"))
    return decisions.decide_linkage(c).select("case_id", "fallback_reason", "prediction")


@query("fusion_decisions", f"with {CLAIMS} select entity_id, attribute, list_sort(string_split(alternatives, ','))[1] as first_allowed, case when list_sort(string_split(alternatives, ','))[1] = selected_value then null else 'unsupported_value' end as fallback_reason, selected_value from fused")
def fusion_decisions(spark, sf_dir):
    claims_ = order_claims(spark, sf_dir)
    c = decisions.allowed_outputs(fusion.fuse(claims_), claims_).withColumnRenamed("supporting_claim_ids", "default_supporting").withColumnRenamed("contradicting_claim_ids", "default_contradicting")
    c = c.withColumn("parsed", decisions.parse(decisions.stand_in("fusion"), "fusion"))
    return decisions.decide_fusion(c).select("entity_id", "attribute", F.get("allowed", F.lit(0)).alias("first_allowed"), "fallback_reason", "selected_value")


@query("daily_usage", "select count(*) as calls, round(coalesce(sum(length(props) / 1024.0), 0), 9)::double as cost from events where cast(ts as date) = date '2024-01-02'")
def daily_usage(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), (F.length("props") / 1024).alias("cost"))
    return decisions.daily_usage(e, F.lit("2024-01-02").cast("date")).withColumn("cost", F.round("cost", 9))


@query("cluster_evidence", f"with {MEMBERS}, p as (select uid, lower(brand) as brand, screen from products) select cluster_root, array_to_string(list_sort(list(distinct source_id)), ',') as sources, array_to_string(list_sort(list(distinct p.brand)), ',') as brands, array_to_string(list_sort(list(distinct screen)), ',') as screens, array_to_string(list_sort(list(distinct gold)), ',') as truths from m join p using (uid) group by 1")
def cluster_evidence(spark, sf_dir):
    return report.cluster_evidence(*brand_clusters(spark, sf_dir)).select("cluster_root", *[F.array_join(c, ",").alias(c) for c in ("sources", "brands", "screens", "truths")])


@query("cluster_errors", f"with {MEMBERS} select 'over' as kind, cluster_root as id, count(distinct gold) as n from m group by 2 having count(distinct gold) > 1 union all select 'under', gold, count(distinct cluster_root) from m group by 2 having count(distinct cluster_root) > 1")
def cluster_errors(spark, sf_dir):
    members, _, truth = brand_clusters(spark, sf_dir)
    over = report.over_merged(members, truth).select(F.lit("over").alias("kind"), F.col("cluster_root").alias("id"), F.col("truths").alias("n"))
    return over.union(report.under_merged(members, truth).select(F.lit("under"), "gold_entity", "clusters"))


@query("linkage_errors", f"with {LABELLED} select left_uid, right_uid, case when label = 1 then 'false_negative' else 'false_positive' end as kind from labelled where label <> (rule_score >= 0.5)::int")
def linkage_errors(spark, sf_dir):
    rows = labelled_pairs(spark, sf_dir).withColumn("prediction", (matching.rule_score() >= 0.5).cast("int"))
    return report.linkage_errors(rows).select("left_uid", "right_uid", "kind")


@query("error_cases", f"with {LABELLED}, e as (select left_uid || '|' || right_uid as case_id, case when label = 1 then 'false_negative' else 'false_positive' end as kind from labelled where label <> (rule_score >= 0.5)::int), r as (select *, row_number() over (partition by kind order by case_id) as k from e) select case_id, kind from r where k <= 3")
def error_cases(spark, sf_dir):
    rows = linkage_errors(spark, sf_dir).select(F.concat_ws("|", "left_uid", "right_uid").alias("case_id"), "kind")
    return report.first_cases(rows, 3, F.col("case_id"))


@query("mediated_coverage", f"""with {VALUES}, f as (select lower(attribute) as a, string_agg(value, ' ' order by ord, value) as j from (select *, row_number() over (partition by attribute order by ord, value) as k from v) where k <= 50 and attribute <> 'size' group by 1),
r as (select a, unnest([case when contains(a, 'title') or a in ('name', 'product name') then 'title' end, case when regexp_matches(a, 'brand|manufacturer|maker') then 'brand' end, case when contains(a, 'model') or regexp_matches(j, '(?i)\\b[A-Z]{{1,5}}[- ]?[0-9]{{2,5}}[A-Z0-9-]*\\b') then 'model identifier' end,
  case when contains(a, 'price') or regexp_matches(j, '(?i)([$€£]|usd|eur|gbp)\\b') then 'price' end, case when contains(a, 'currency') then 'currency' end, case when regexp_matches(a, 'description|features') then 'description' end, case when regexp_matches(a, 'category|type') then 'category' end]) as role from f)
select count(distinct role) as mediated_coverage from r""")
def mediated_coverage(spark, sf_dir):
    return report.mediated_coverage(profiles(spark, sf_dir).filter("attribute <> 'size'"))


@query("run_summary", """select event_type as configuration, round((coalesce(a, 0) + coalesce(b, 0)) / ((a is not null)::int + (b is not null)::int), 4) as end_to_end from (select event_type, case when event_type <> 'click' then avg((value > 10)::int) end as a, avg((user_id % 2)) as b from events group by 1)""")
def run_summary(spark, sf_dir):
    m = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("configuration")).agg(F.avg((F.col("value") > 10).cast("int")).alias("a"), F.avg(F.col("user_id") % 2).alias("b"))
    m = m.withColumn("a", F.when(F.col("configuration") != "click", F.col("a")))
    return m.select("configuration", report.rounded(report.mean_present("a", "b")).alias("end_to_end"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims on customers, fused into one canonical record each."""
    return integrated_entities(spark, sf_dir)
