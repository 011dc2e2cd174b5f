"""More registered queries: candidates, evidence, routing records, budgets, calls and release tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.operators import candidates, cases as evidence, clustering, fusion, report, routes, routing, subset
from knitwork.plans import provider
from knitwork.plans.registry import CASES, CLAIMS, DECIDED, LABELLED, MEMBERS, PRODUCTS, brand_clusters, cases, decided, labelled_pairs, order_claims, part_records, products, query
from knitwork.session import cut_lineage, read_table, scratch_path
from knitwork.sources import discovery


# --- candidates

POINTS = " + ".join(f"least({n} / {full}::double, 1) * {p}" if full else f"{n} * {p}" for n, (full, p) in candidates.POINTS.items())
BRANDS = """b as (select p_brand as dataset_id, count(distinct p_type)::double as source_count, count(*)::double as record_count, count(distinct p_name)::double as entity_count, max(p_size)::double as positive_pair_count, 4.0::double as mediated_coverage, 0.5::double as schema_heterogeneity,
  count(distinct p_size) / count(*)::double as overlap_score, count(p_size)::double as labeled_record_count, sum(p_size)::double as fusion_conflict_count, 0.25::double as model_number_coverage, 1.0::double as title_signal_coverage from part group by 1)"""


def brand_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    n = lambda c: c.cast("double")
    out = p.groupBy(F.col("p_brand").alias("dataset_id")).agg(
        n(F.countDistinct("p_type")).alias("source_count"), n(F.count("*")).alias("record_count"), n(F.countDistinct("p_name")).alias("entity_count"), n(F.max("p_size")).alias("positive_pair_count"), F.lit(4.0).alias("mediated_coverage"),
        F.lit(0.5).alias("schema_heterogeneity"), (F.countDistinct("p_size") / F.count("*")).alias("overlap_score"), n(F.count("p_size")).alias("labeled_record_count"), n(F.sum("p_size")).alias("fusion_conflict_count"),
        F.lit(0.25).alias("model_number_coverage"), F.lit(1.0).alias("title_signal_coverage"),
    )
    return out.withColumn("selection_score", candidates.local_score())


@query("local_scores", f"with {BRANDS} select dataset_id, round({POINTS}, 4) as selection_score from b")
def local_scores(spark, sf_dir):
    return brand_metrics(spark, sf_dir).select("dataset_id", "selection_score")


@query("best_candidate", f"with {BRANDS} select dataset_id, round({POINTS}, 4) as selection_score from b where record_count >= 5 order by 2 desc, 1 limit 1")
def best_candidate(spark, sf_dir):
    return candidates.best_candidate(brand_metrics(spark, sf_dir), F.col("record_count") >= 5).select("dataset_id", "selection_score")


@query("selection_table", f"with {BRANDS}, s as (select dataset_id, round({POINTS}, 4) as selection_score, record_count >= 5 as passes from b) select *, cast(row_number() over (partition by passes order by selection_score desc, dataset_id) as int) as rank from s")
def selection_table(spark, sf_dir):
    return candidates.selection_table(brand_metrics(spark, sf_dir), F.col("record_count") >= 5).select("dataset_id", "selection_score", "passes", "rank")


GOLD = """g as (select 'e' || (p_partkey % 50) as entity_id, 's' || (p_partkey % 7) || case when p_partkey % 2 = 0 then ':' else '//' end || p_partkey as spec_id, p_partkey from part where p_partkey % 3 <> 0)"""


def part_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0")
    key = F.col("p_partkey").cast("string")
    spec = F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ":").otherwise("//"), key)
    return p.select(F.concat(F.lit("e"), (F.col("p_partkey") % 50).cast("string")).alias("entity_id"), spec.alias("spec_id"))


@query("resolved_specs", f"with {GOLD} select entity_id, 's' || (p_partkey % 7) || ':' || p_partkey as record_uid from g")
def resolved_specs(spark, sf_dir):
    return candidates.resolve_specs(part_gold(spark, sf_dir), part_records(spark, sf_dir))


@query("gold_conflicts", f"""with {GOLD}, v as (select entity_id, 'brand' as attribute, lower(trim(p_brand)) as value from g join part using (p_partkey) union all select entity_id, 'size', cast(p_size as varchar) from g join part using (p_partkey))
select entity_id, attribute, count(distinct value) as n from v group by 1, 2 having count(distinct value) > 1""")
def gold_conflicts(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    pair = lambda name, c: F.struct(F.lit(name).alias("attribute"), F.col(c).cast("string").alias("value"))
    uid = F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string"), F.lit(":"), F.col("p_partkey").cast("string"))
    values = p.select(uid.alias("record_uid"), F.explode(F.array(pair("Brand", "p_brand"), pair("size", "p_size"))).alias("x")).select("record_uid", "x.*")
    return candidates.fusion_conflicts(part_gold(spark, sf_dir), part_records(spark, sf_dir), values)


@query("overlap_score", f"with {GOLD}, s as (select entity_id, count(*) as n from g group by 1) select sum(case when n > 1 then n else 0 end) / 5000.0::double as overlap_score from s")
def overlap_score(spark, sf_dir):
    return candidates.overlap_score(part_gold(spark, sf_dir), 5000)


@query("spec_lists", f"with {GOLD} select entity_id, array_to_string(list_sort(list(spec_id)), ',') as specs from (select * from g union all select * from g where p_partkey % 10 = 1) group by 1")
def spec_lists(spark, sf_dir):
    g = part_gold(spark, sf_dir)
    return subset.spec_lists(g.unionByName(g.filter("spec_id like '%1'"))).select("entity_id", F.array_join("specs", ",").alias("specs"))


@query("dataset_summary", f"""with {GOLD}, s as (select entity_id, count(*) as n from g group by 1) select (select count(distinct p_partkey % 7) from part) as source_count, (select count(*) from part) as record_count, count(*) as entity_count, sum(n)::bigint as labeled_record_count, sum(n * (n - 1) // 2)::bigint as positive_pair_count, 8 as mediated_attribute_count from s""")
def dataset_summary(spark, sf_dir):
    return report.dataset_summary(part_records(spark, sf_dir), part_gold(spark, sf_dir), 8)


@query("manifest_mismatches", "select count(*) as counted, (select count(*) from part) + 1 as total from part")
def manifest_mismatches(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return discovery.manifest_mismatches(p.groupBy("p_brand").agg(F.count("*").alias("record_count")), p.count() + 1)


@query("leak_guard", "select n_nationkey, n_name from nation")
def leak_guard(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return discovery.without_gold(n.select("n_nationkey", "n_name", F.col("n_regionkey").alias("left_GOLD"), F.lit(1).alias("ground_truth_label")))


@query("nonempty_sets", "select n_nationkey, array_to_string(list_sort(list_distinct(list_filter([n_name, '', case when n_nationkey % 2 = 0 then n_name end, substr(n_name, 1, 2)], lambda x: x is not null and x <> ''))), ',') as names from nation")
def nonempty_sets(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    values = F.array("n_name", F.lit(""), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.substring("n_name", 1, 2))
    return n.select("n_nationkey", F.array_join(discovery.nonempty(values), ",").alias("names"))


# --- metrics of stages

CONFIDENT = "n as (select cast(c_nationkey as varchar) as record_uid, (c_custkey % 10) / 10.0::double as confidence from customer)"


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("record_uid"), (F.col("c_custkey") % 10 / 10).alias("confidence"))


@query("record_confidence", f"with {CONFIDENT} select record_uid, round(avg(confidence), 9) as confidence from n group by 1")
def record_confidence(spark, sf_dir):
    return report.record_confidence(confident(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query("normalization_metrics", f"with {CONFIDENT} select count(distinct record_uid) as record_count, count(*) as normalized_value_count, round(avg(confidence), 9) as average_confidence from n")
def normalization_metrics(spark, sf_dir):
    return report.normalization_metrics(confident(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 9))


@query("claim_metrics", f"with {CLAIMS} select count(*) as claim_count, count(distinct ord) as record_count_with_claims, count(distinct entity_id) as entity_count_with_claims from c")
def claim_metrics(spark, sf_dir):
    return report.claim_metrics(order_claims(spark, sf_dir).withColumn("record_uid", F.col("ord")))


@query("confusion_matrix", f"with {LABELLED} select count(*) filter (label = 1 and rule_score >= 0.5) as true_positive, count(*) filter (label = 0 and rule_score >= 0.5) as false_positive, count(*) filter (label = 0 and rule_score < 0.5) as true_negative, count(*) filter (label = 1 and rule_score < 0.5) as false_negative from labelled where split = 'train'")
def confusion_matrix(spark, sf_dir):
    from knitwork.operators import matching

    scored = labelled_pairs(spark, sf_dir).withColumn("prediction", (matching.rule_score() >= 0.5).cast("int"))
    return report.confusion(matching.classification_metrics(scored), "train")


@query("component_members", f"with {PRODUCTS}, l as (select uid, title, row_number() over (partition by title order by uid) as k from products) select uid, min(uid) over (partition by title) as cluster_root from l")
def component_members(spark, sf_dir):
    p = products(spark, sf_dir)
    first = p.groupBy("title").agg(F.min("uid").alias("left_uid"))
    edges = p.join(first, "title").filter("uid <> left_uid").select("left_uid", F.col("uid").alias("right_uid"), F.lit(0.6).alias("match_probability"))
    weak = p.limit(2).agg(F.min("uid").alias("left_uid"), F.max("uid").alias("right_uid"), F.lit(0.4).alias("match_probability"))
    return clustering.component_members(p, edges.unionByName(weak))


@query("component_clusters", f"""with {MEMBERS}, s as (select cluster_root, min(uid) as first_uid, count(*) as size from m group by 1) select 'cc_' || lpad(cast(row_number() over (order by first_uid) as varchar), 6, '0') as entity_id, cluster_root, size from s""")
def component_clusters(spark, sf_dir):
    members, p, truth = brand_clusters(spark, sf_dir)
    return clustering.cluster_rows(members, p, truth, prefix="cc").select("entity_id", "cluster_root", "size")


@query("cluster_signatures", f"""with {MEMBERS}, p as (select uid, brand, model_number, screen from products) select cluster_root, count(*) as members, count(distinct gold)::int as truth_count, array_to_string(list_sort(list(distinct screen)), ',') as screens, '' as resolutions from m join p using (uid) group by 1""")
def cluster_signatures(spark, sf_dir):
    rows = report.cluster_evidence(*brand_clusters(spark, sf_dir))
    return rows.select("cluster_root", "members", "truth_count", F.array_join("screens", ",").alias("screens"), F.array_join("resolutions", ",").alias("resolutions"))


@query("flat_records", """select lpad(cast(p_partkey as varchar), 8, '0') as record_uid, 'record_uid=' || lpad(cast(p_partkey as varchar), 8, '0') || ',source_id=s,source_record_id=' || p_partkey || ',spec_body_colour=' || coalesce(p_brand, '') || ',spec_screen_size=' || p_size || case when p_partkey % 3 <> 0 then ',title=' || p_name else '' end as fields from part""")
def flat_records(spark, sf_dir):
    from knitwork.plans.integration import flat_records as flat

    p = read_table(spark, sf_dir, "part")
    row = lambda n, t, a, v: F.struct(F.lit(n).alias("attr_ord"), F.lit(t).alias("target"), F.lit(a).alias("attribute"), v.cast("string").alias("value"))
    rows = F.array(row(0, "title", "name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))), row(1, "specifications", "Screen Size", F.col("p_size")), row(2, "specifications", "Body Colour", F.col("p_brand")), row(3, "specifications", "screen size", F.lit("later")))
    long = p.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("record_uid"), F.lit("s").alias("source_id"), F.col("p_partkey").cast("string").alias("source_record_id"), F.explode(rows).alias("x")).select("record_uid", "source_id", "source_record_id", "x.*")
    entries = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return flat(long).select("record_uid", F.array_join(entries, ",").alias("fields"))


@query("fusion_metrics", f"""with {CLAIMS}, k as (select count(*) as evaluated, sum((selected_value = '1-URGENT')::int)::bigint as correct from fused where attribute = 'priority'), b as (select count(*) as evaluated, count(*) as correct from fused where attribute = 'total')
select 'curated' as kind, evaluated, correct, correct / evaluated::double as accuracy from k union all select 'primary', evaluated, correct, correct / evaluated::double from k union all select 'bootstrap', evaluated, correct, 1.0 from b""")
def fusion_metrics(spark, sf_dir):
    fused = cut_lineage(fused_entities(spark, sf_dir).select("entity_id", "attribute", "selected_value"))
    curated = fused.filter("attribute = 'priority'").select("entity_id", "attribute", F.lit("1-urgent").alias("truth"))
    bootstrap = fused.filter("attribute = 'total'").select("entity_id", "attribute", F.col("selected_value").alias("truth"))
    return fusion.fusion_metrics(fused, spark.createDataFrame([], "entity_id string, primary_truth string"), bootstrap, curated).drop("gold_available")


@query("batch_answers", f"with {CASES}, r as (select *, (row_number() over (order by route_ord) - 1) // 10 as batch_id from (select * from cases order by route_ord limit 200)) select cast(batch_id as int) as batch_id, case_id, case when match_probability >= 0.5 then 'match' else 'non_match' end as decision, greatest(0.55, least(0.9, abs(match_probability - 0.5) + 0.5)) as confidence from r")
def batch_answers(spark, sf_dir):
    from knitwork.operators import decisions

    batched = routing.batches(routing.top_cases(cases(spark, sf_dir), 200, F.col("route_ord")), 10, F.col("route_ord"))
    return decisions.parse_batch(decisions.stand_in_batches(batched, "linkage"), "linkage").select("batch_id", "case_id", "parsed.decision", "parsed.confidence")


@query("claim_prompts", """select 'c' || o_orderkey as claim_id, '{"claim_id":"c' || o_orderkey || '","source_id":"o","raw_value":"' || o_orderpriority || '","normalized_value":"' || lower(o_orderpriority) || '","unit":"","extraction_confidence":0.5}' as prompt from orders""")
def claim_prompts(spark, sf_dir):
    from knitwork.operators import decisions

    o = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("claim_id"), F.lit("o").alias("source_id"), F.col("o_orderpriority").alias("raw_value"), F.lower("o_orderpriority").alias("value"), F.lit("").alias("unit"), F.lit(0.5).alias("confidence"), F.lit("x").alias("gold"))
    return o.select("claim_id", F.to_json(decisions.claim_prompt()).alias("prompt"))


# --- error cases

def fused_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(order_claims(spark, sf_dir))


@query("fusion_mismatches", f"with {CLAIMS} select entity_id, attribute, selected_value as value, '1-URGENT' as gold_value from fused where attribute = 'priority' and selected_value <> '1-URGENT'")
def fusion_mismatches(spark, sf_dir):
    fused = fused_entities(spark, sf_dir)
    gold = fused.filter("attribute = 'priority'").select("entity_id", "attribute", F.lit(" 1-urgent").alias("truth"))
    return fusion.fusion_mismatches(fused, gold, spark.createDataFrame([], "entity_id string, primary_truth string")).withColumn("gold_value", F.upper(F.trim("gold_value")))


def order_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Memberships of orders in customers, and the orders' evidence."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_uid"), F.col("o_custkey").cast("string").alias("entity_id"), F.lit("orders").alias("source_id"), F.col("o_orderkey").cast("string").alias("source_record_id"), F.col("o_orderpriority").alias("normalized_payload"))
    raw = o.filter("cast(record_uid as long) % 2 = 0").select("record_uid", F.col("normalized_payload").alias("raw_payload"))
    return o.select("record_uid", "entity_id"), evidence.record_evidence(o.drop("entity_id"), raw)


@query("fusion_cases", f"""with {CLAIMS}, w as (select entity_id, selected_value, row_number() over (order by entity_id) as k from fused where attribute = 'priority' and selected_value <> '1-URGENT' order by entity_id limit 2),
m as (select k, w.entity_id, selected_value, cast(o_orderkey as varchar) as uid, o_orderkey, o_orderpriority as p, row_number() over (partition by k order by cast(o_orderkey as varchar)) as n from w join orders on cast(o_custkey as varchar) = w.entity_id)
select 'fusion_' || k || '_' || entity_id as case_id, '{{"attribute":"priority","entity_id":"' || entity_id || '","value":"' || any_value(selected_value) || '"}}' as system_output, '{{"gold_value":"1-URGENT"}}' as expected_output,
  string_agg('{{"record_uid":"' || uid || '","source_id":"orders","source_record_id":"' || uid || '","normalized_payload":"' || p || '"' || case when o_orderkey % 2 = 0 then ',"raw_payload":"' || p || '"' else '' end || '}}', '|' order by n) as source_records from m where n <= 3 group by k, entity_id""")
def fusion_cases(spark, sf_dir):
    members, shown = order_evidence(spark, sf_dir)
    rows = evidence.fusion_cases(fusion_mismatches(spark, sf_dir), members, shown)
    return rows.select("case_id", "system_output", "expected_output", F.array_join("source_records", "|").alias("source_records"))


@query("cluster_cases", """with u as (select n_regionkey, list_sort(list(cast(n_nationkey as varchar))) as predicted from nation group by 1 order by cast(n_regionkey as varchar) limit 1)
select 'cluster_undermerge_' || n_regionkey as case_id, '{"predicted":[' || array_to_string(list_transform(predicted, lambda x: '"' || x || '"'), ',') || '],"predicted_cluster_count":' || len(predicted) || '}' as system_output, '{"expected_cluster_count":1,"gold_entity":"' || n_regionkey || '"}' as expected_output,
  (select string_agg(uid, ',' order by place, uid) from (select cast(c_custkey as varchar) as uid, list_position(predicted, cast(c_nationkey as varchar)) as place from customer where cast(c_nationkey as varchar) = any(predicted[1:2]) order by place, uid limit 4)) as uids from u""")
def cluster_cases(spark, sf_dir):
    under = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("gold_entity")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("string"))).alias("predicted"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_uid"), F.col("c_nationkey").cast("string").alias("entity_id"), F.lit("c").alias("source_id"), F.lit("r").alias("source_record_id"), F.lit("{}").alias("normalized_payload"))
    shown = evidence.record_evidence(c.drop("entity_id"), c.select("record_uid", F.lit("{}").alias("raw_payload")).limit(0))
    rows = evidence.cluster_case(under, c.select("record_uid", "entity_id"), shown)
    return rows.select("case_id", "system_output", "expected_output", F.array_join(F.transform("source_records", lambda x: F.get_json_object(x, "$.record_uid")), ",").alias("uids"))


@query("schema_cases", """select 'schema_part//brand' as case_id, '{"score":0.7,"source_attribute_id":"part//brand","target":"title"}' as system_output, '{"gold_target":"brand"}' as expected_output,
  (select string_agg('{"record_uid":"' || u || '","source_id":"part","attribute":"brand","value":"' || p_brand || '"}', '|' order by u) from (select lpad(cast(p_partkey as varchar), 8, '0') as u, p_brand from part order by 1 limit 3)) as source_records""")
def schema_cases(spark, sf_dir):
    values = read_table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("record_uid"), F.lit("part").alias("source_id"), F.lit("brand").alias("attribute"), F.col("p_brand").alias("value"))
    wrong = spark.createDataFrame([("part//brand", "part", "brand", "title", 0.7, "brand"), ("part//size", "part", "size", "price", 0.6, "screen")], "source_attribute_id string, source_id string, attribute string, target string, score double, gold_target string")
    rows = evidence.schema_case(wrong, values)
    return evidence.flat(rows).select("case_id", "system_output", "expected_output").join(rows.select("case_id", F.array_join("source_records", "|").alias("source_records")), "case_id")


@query("linkage_cases", f"""with {LABELLED}, e as (select left_uid, right_uid, label, case when label = 1 then 'false_negative' else 'false_positive' end as kind from labelled where label <> (rule_score >= 0.5)::int), r as (select *, row_number() over (partition by kind order by left_uid, right_uid) as k from e)
select 'linkage_' || kind || '_' || left_uid || '_' || right_uid as case_id, 'linkage' as stage, left_uid || ',' || right_uid as uids, '{{"label":' || label || '}}' as expected_output from r where k <= 2""")
def linkage_cases(spark, sf_dir):
    from knitwork.operators import matching

    wrong = report.linkage_errors(labelled_pairs(spark, sf_dir).withColumn("prediction", (matching.rule_score() >= 0.5).cast("int")))
    p = products(spark, sf_dir).select(F.col("uid").alias("record_uid"), "source_id", F.col("uid").alias("source_record_id"), F.col("title").alias("normalized_payload"))
    rows = evidence.linkage_cases(wrong, evidence.record_evidence(p, p.select("record_uid", F.lit("{}").alias("raw_payload"))))
    return rows.select("case_id", "stage", F.array_join(F.transform("source_records", lambda x: F.get_json_object(x, "$.record_uid")), ",").alias("uids"), "expected_output")


# --- routing records, budgets and calls

@query("unsupported_values", f"with {DECIDED} select count(*) as unsupported_value_count from d where fallback_reason = 'low_confidence'")
def unsupported_values(spark, sf_dir):
    d = decided(spark, sf_dir).withColumn("fallback_reason", F.when(F.col("fallback_reason") == "low_confidence", "unsupported_value").otherwise(F.col("fallback_reason")))
    return routes.unsupported_values(d.filter("route_ord % 2 = 0"), d.select("case_id"), d.filter("route_ord % 2 = 1"))


@query("batch_routes", f"""with {DECIDED}, r as (select *, (row_number() over (order by route_ord) - 1) % 10 as batch_index from (select * from d order by route_ord limit 500))
select case_id, true as selected, fallback_reason is null as accepted, fallback_reason, case when batch_index = 0 then 1 else 0 end as call_count_charge, case when batch_index = 0 then length(payload) else 0 end as input_tokens, round(case when batch_index = 0 then estimated_cost else 0 end, 9) as cost, fallback_reason is not null as defaulted, cast(batch_index as int) as batch_index from r""")
def batch_routes(spark, sf_dir):
    d = routing.batches(routing.top_cases(decided(spark, sf_dir), 500, F.col("route_ord")), 10, F.col("route_ord")).withColumn("input_tokens", F.length("payload")).withColumn("cost", F.col("estimated_cost"))
    rows = routes.batched(d, F.col("fallback_reason"))
    return rows.select("case_id", "selected", "accepted", "fallback_reason", "call_count_charge", "input_tokens", F.round("cost", 9).alias("cost"), "defaulted", "batch_index")


@query("uncalled_routes", f"""with {CASES}, x as (select *, route_ord % 5 = 0 as selected from cases) select stage, case_id, 'stage_case_limit' as fallback_reason, 'not_called' as validation_status, true as defaulted, false as summary, -1::bigint as eligible_count, -1::bigint as unselected_default_count from x where not selected
union all select 'click', '__primary_summary__', 'summary', 'summary', false, true, count(*), count(*) filter (not selected) from x""")
def uncalled_routes(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("selected", F.col("route_ord") % 5 == 0)
    rows = routes.defaulted(c.filter("not selected"), F.lit("stage_case_limit")).unionByName(routes.summary(c, "click"))
    return rows.select("stage", "case_id", "fallback_reason", "validation_status", "defaulted", "summary", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("eligible_count", "unselected_default_count")])


BUDGET = provider.Budget(stage_cases=40, run_calls=120, daily_calls=110, run_cost=0.9, daily_cost=1.2)
USED = provider.Used(run_calls=5, run_cost=0.05, daily_calls=10, daily_cost=0.2)


@query("budget_limits", f"""with {CASES}, a as (select *, row_number() over (partition by stage order by route_ord) as s from cases), b as (select *, count(*) filter (s <= 40) over w as n, sum(case when s <= 40 then estimated_cost end) over w as spent from a window w as (order by route_ord))
select case_id, case when s > 40 then 'stage_case_limit' when n + 5 > 120 then 'per_run_call_budget' when n + 15 > 110 then 'daily_call_budget' when estimated_cost > 0 and spent + 0.05 > 0.9 then 'per_run_cost_budget' when estimated_cost > 0 and spent + 0.25 > 1.2 then 'daily_cost_budget' else 'selected' end as reason from b""")
def budget_limits(spark, sf_dir):
    return provider.gate(cases(spark, sf_dir), BUDGET, USED).select("case_id", "reason")


@query("budget_replay", f"with {CASES} select count(*)::bigint as calls, round(sum(estimated_cost), 6) as cost from cases where route_ord % 3 = 0")
def budget_replay(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("call_count_charge", (F.col("route_ord") % 3 == 0).cast("int")).withColumn("cost", F.col("estimated_cost"))
    used = provider.replay(c)
    return spark.createDataFrame([(sum(n for _, n in used.by_stage), round(used.run_cost, 6))], "calls long, cost double")


@query("prompt_render", """select event_id, 'Decide click for {"k":' || event_id % 3 || '} of ' || event_type || ', {{other}}' as prompt from events""")
def prompt_render(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    values = {"payload": F.to_json(F.struct((F.col("event_id") % 3).alias("k"))), "kind": F.col("event_type")}
    return e.select("event_id", provider.render("Decide click for {{payload}} of {{kind}}, {{other}}", values).alias("prompt"))


@query("structured_calls", f"""with {CASES} select stage, case when route_ord % 4 = 0 then 'hit' else 'miss' end as cache_status, count(*) as calls, count(*) filter (route_ord % 5 = 0) as invalid from (select 'linkage' as stage, route_ord from cases) group by 1, 2""")
def structured_calls(spark, sf_dir):
    c = cases(spark, sf_dir).select("case_id", "route_ord", F.lit("linkage").alias("stage"), "match_probability").withColumn("payload", F.concat_ws("|", "case_id", F.col("match_probability").cast("string")))
    c = c.withColumn("response", F.when(F.col("route_ord") % 5 == 0, F.lit("{}")).otherwise(provider.decisions.stand_in("linkage")))
    model = provider.Model()
    cache = c.filter("route_ord % 4 = 0").select(provider.input_hash(F.col("stage"), F.col("payload"), model).alias("input_hash"), "response")
    log = scratch_path(spark, "calls")
    out = provider.structured_calls(c.drop("match_probability"), None, model, cache, log)
    logged = spark.read.schema(provider.LOG).json(log).select("case_id").join(out.filter("cache_status = 'miss'"), "case_id").select(out.columns)
    return out.filter("cache_status = 'hit'").unionByName(logged).groupBy("stage", "cache_status").agg(F.count("*").alias("calls"), F.count(F.when(F.col("validation_status") == "invalid", 1)).alias("invalid"))


# --- release tables

OPS = "o as (select event_type as configuration, count(*)::bigint as calls, sum((value > 10)::int)::bigint as accepted, sum((value <= 10)::int)::bigint as fallbacks, sum((user_id % 7 = 0)::int)::bigint as invalid, sum((user_id % 11 = 0)::int)::bigint as abstained, sum(length(props) / 1024.0) as cost, avg(value) as latency from events group by 1)"


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    n = lambda c: c.cast("int")
    return e.select(F.col("event_type").alias("configuration"), F.lit(1).alias("selected"), n(F.col("value") > 10).alias("accepted"), n(F.col("value") <= 10).alias("fallbacks"), n(F.col("user_id") % 7 == 0).alias("invalid"), n(F.col("user_id") % 11 == 0).alias("abstained"), (F.length("props") / 1024).alias("cost"), F.col("value").alias("latency_ms"))


@query("operational_summary", f"with {OPS} select configuration, calls, accepted, fallbacks, round(cost, 6) as cost, round(latency, 6) as average_latency_ms, round(invalid / calls::double, 4) as invalid_output_rate, round(abstained / calls::double, 4) as abstention_rate, round(fallbacks / calls::double, 4) as fallback_rate from o")
def operational_summary(spark, sf_dir):
    return routes.operational(event_runs(spark, sf_dir)).withColumn("cost", F.round("cost", 6)).withColumn("average_latency_ms", F.round("average_latency_ms", 6))


RENAMED = "(select row_number() over (order by configuration) - 1 as k, * from o)"


@query("budget_series", f"""with {OPS}, n(configuration, k) as (values ('Budget-0', 0), ('Budget-5', 1), ('Budget-10', 2), ('Budget-25', 99)), r as {RENAMED} select n.configuration, coalesce(calls, 0) as calls, round(coalesce(accepted / calls::double, 0), 6) as end_to_end, round(coalesce(fallbacks / calls::double, 0), 6) as linkage_f1, round(coalesce(cost, 0), 6) as cost from n left join r using (k)""")
def budget_series(spark, sf_dir):
    kinds = [r.configuration for r in event_runs(spark, sf_dir).select("configuration").distinct().orderBy("configuration").collect()]  # a handful of event types
    names = spark.createDataFrame([(k, n) for k, n in zip(kinds, ("Budget-0", "Budget-5", "Budget-10"), strict=False)], "configuration string, name string")
    ops = routes.operational(event_runs(spark, sf_dir)).join(names, "configuration").drop("configuration").withColumnRenamed("name", "configuration")
    summaries = ops.select("configuration", (F.col("accepted") / F.col("calls")).alias("end_to_end"), (F.col("fallbacks") / F.col("calls")).alias("linkage_f1"))
    return report.budget_series(summaries, ops).select("configuration", "calls", *[F.round(c, 6).alias(c) for c in ("end_to_end", "linkage_f1", "cost")])


@query("last_by_configuration", "select event_type as configuration, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1")
def last_by_configuration(spark, sf_dir):
    return report.last_by_configuration(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("configuration"), "event_id", "value"), "event_id")


@query("report_labels", "select n_name, case n_nationkey % 5 when 0 then 'Deterministic' when 1 then 'LLM' when 2 then 'Hybrid' when 3 then 'Deterministic Scale' else 'B-S' end as label from nation")
def report_labels(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("A0", "C-LLM", "B-All", "A0-camera", "B-S"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "nation").select("n_name", report.label(name).alias("label"))


@query("uncovered_runs", "select n_name as configuration from nation where n_nationkey % 3 = 0")
def uncovered_runs(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return report.uncovered(n.select(F.col("n_name").alias("configuration"), F.when(F.col("n_nationkey") != 0, F.col("n_nationkey") % 3).alias("fusion_evaluated")))


@query("preferred_metric", "select c_custkey, case when c_acctbal > 0 then c_acctbal else c_custkey::double end as metric from customer")
def preferred_metric(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    row = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("assisted"), F.col("c_custkey").cast("double").alias("baseline"))
    return c.select("c_custkey", report.preferred(row, "assisted", "baseline").alias("metric"))


@query("subset_files", f"""with {GOLD}, e as (select entity_id from g group by 1 order by count(*) desc, entity_id limit 10) select 's' || (p_partkey % 7) as source_id, count(*) as records from g join e using (entity_id) where spec_id like '%//%' group by 1""")
def subset_files(spark, sf_dir):
    gold = part_gold(spark, sf_dir)
    chosen = gold.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(10)
    path = scratch_path(spark, "subset")
    subset.materialize(path, chosen, gold, cut_lineage(part_records(spark, sf_dir)))
    return spark.read.schema("source_record_id string, payload string, source_id string").json(f"{path}/records").groupBy("source_id").agg(F.count("*").alias("records"))
