"""Registered queries of the decision protocol and of the rule programs on Russian texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures
from tessera.functions.lexicons import DIVERSITY_GATES, ENGLISH, GATES, PROFILE_VALUES, RUSSIAN, SIGNALS
from tessera.functions import text as T
from tessera.operators import decisions, features, integrity, protocol, requirements
from tessera.plans.lineage import cut
from tessera.queries import _ALERTS, _JARGON, _LABELS, _SUMMARY, _TOKEN, _alerts, _annotations, _mode, _signals, _sql_count, query, table

SIGNAL = "context-jargon-density"
CONTROL = "that this with " * 20


# ---- rule programs ------------------------------------------------------------------------


def _dealt(rows: DataFrame, number: F.Column, given: tuple[fixtures.Expected, ...]) -> DataFrame:
    """Adds ``text`` and ``other`` of the fixtures, dealt out by a number."""
    of = lambda name: F.get(F.array(*[F.lit(getattr(x, name)) for x in given]), F.pmod(number, F.lit(len(given))).cast("int"))
    return rows.select(*rows.columns, of("text").alias("text"), of("other").alias("other"))


@query(f"select doc_id, code, level, n from documents join (values {fixtures.sql_values(fixtures.PROSE)}) e(i, code, level, n) on doc_id % {len(fixtures.PROSE)} = i")
def prose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), fixtures.PROSE).withColumnRenamed("other", "mode")
    known = features.profiles(spark)
    marks = known.where("profile = 'prose'").withColumns({"profile": F.lit("marks"), "dash_level": F.lit("info"), "colon_level": F.lit("info")})
    found = features.prose_findings(docs, known.unionByName(marks), RUSSIAN)
    return found.groupBy("doc_id", "code", "level").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"select doc_id, code, line, n from documents join (values {fixtures.sql_values(fixtures.REQUIREMENTS)}) e(i, code, line, n) on doc_id % {len(fixtures.REQUIREMENTS)} = i")
def requirement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), fixtures.REQUIREMENTS).select("doc_id", "text")
    found = requirements.requirement_findings(docs, "gost19")
    return found.groupBy("doc_id", "code", "line").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"select conv_id, turn, code, n_removed, n_added from conversations join (values {fixtures.sql_values(fixtures.INTEGRITY)}) e(i, code, n_removed, n_added) on (conv_id + turn) % {len(fixtures.INTEGRITY)} = i")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn"), F.col("conv_id") + F.col("turn"), fixtures.INTEGRITY)
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return integrity.integrity_findings(pairs, "text", "other").select("conv_id", "turn", "code", size("removed").alias("n_removed"), size("added").alias("n_added"))


# ---- splits -------------------------------------------------------------------------------

_FAR = "abs({d} - o.all_docs * 0.6::double) / greatest(o.all_docs, 1) + abs({w} - o.all_words * 0.6::double) / greatest(o.all_words, 1)"


def _sql_split(group: str, rows: str) -> str:
    """CTEs that end in ``arms(g, component, arm)``; ``rows`` has ``doc_id, text, words`` and the group."""
    return f"""
comp as (select doc_id, {group} as g, words, min(doc_id) over (partition by text) as component from {rows}),
sized as (select g, component, count(*) as docs, sum(words)::bigint as words, sha256(concat_ws('|', '{GATES["seed"]}', g, component)) as mark from comp group by g, component),
o as (select *, row_number() over (partition by g order by mark) as r, count(*) over (partition by g) as n, sum(docs) over (partition by g)::double as all_docs, sum(words) over (partition by g)::double as all_words from sized),
fold(g, r, d, w, cal) as (select g, 0::bigint, 0::double, 0::double, false from o where r = 1 union all
  select g, r, case when t then d + docs else d end, case when t then w + words else w end, t from (
    select o.*, f.d, f.w, {_FAR.format(d="(f.d + o.docs)", w="(f.w + o.words)")} <= {_FAR.format(d="f.d", w="f.w")} as t from fold f join o on o.g = f.g and o.r = f.r + 1) o),
arms as (select g, component, case when n > 1 and in_cal = n and r = n then 'validation' when n > 1 and in_cal = 0 and r = 1 then 'calibration' when cal then 'calibration' else 'validation' end as arm
  from (select o.*, f.cal, sum(f.cal::int) over (partition by o.g) as in_cal from o join fold f on f.g = o.g and f.r = o.r) o)"""


_WORDS = _sql_count("text", _TOKEN)


def _components(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Components of equal texts of each document, and their arm within each group."""
    parts = cut(decisions.split_components(rows, "doc_id", ["split_group"], []))
    sized = rows.join(parts, "doc_id").groupBy(by, "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"))
    return parts, decisions.greedy_split(sized, [by])


# ---- decisions ----------------------------------------------------------------------------


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts, gates and both decisions of each profile for one signal, and the profiles' gates."""
    rows = cut(_signals(spark, sf_dir).where(F.col("signal") == SIGNAL).withColumn("author_or_group", F.col("channel")).select(
        "id", F.col("id").alias("doc_id"), "profile", "signal", "words", "source_id", "channel", "author_or_group", "split_group",
        "direction", "value", "hit_count", "min_hits", "old", "eligible", "applicable", "threshold_key", "quantile"))
    parts, arms = _components(rows.where("eligible"), "profile")
    dealt = cut(rows.join(parts, "doc_id").join(arms, ["profile", "component"]).select(*rows.columns, "arm"))
    profiles_ready = cut(protocol.profile_gates(rows))
    gates = protocol.evidence_gates(rows, dealt.select("profile", "signal", "id", "arm"), profiles_ready)
    found = decisions.candidate_thresholds(dealt.where("arm = 'calibration'"), ["profile"]).select("profile", "candidate")
    fired = dealt.where("arm = 'validation'").join(found, "profile", "left").withColumn("candidate", F.coalesce("candidate", "old"))
    alerts = cut(fired.withColumn("old_fires", decisions.fires(F.col("old"))).withColumn("candidate_fires", decisions.fires(F.col("candidate"))))
    labels = _annotations(spark, sf_dir)
    summary = lambda part, names: decisions.annotation_summary(part, labels, ["profile"], ["id"]).select("profile", *[F.col(a).alias(b) for a, b in names.items()])
    old = summary(alerts.where("old_fires"), {"alerts": "alerts", "decisive": "alerts_decisive", "actionable_precision": "alerts_precision"})
    gone = summary(alerts.where("old_fires and not candidate_fires"), {"alerts": "removed", "decisive": "removed_decisive", "non_actionable": "removed_non_actionable"})
    thresholds = rows.groupBy("profile").agg(F.first("old").alias("old")).join(found, "profile", "left").withColumn("candidate", F.coalesce("candidate", "old"))
    wide = gates.join(thresholds, "profile").join(old, "profile", "left").join(gone, "profile", "left").join(_control(spark, thresholds), "profile")
    filled = wide.na.fill(0, ["alerts", "alerts_decisive", "removed", "removed_decisive", "removed_non_actionable"])
    return cut(filled.withColumn("candidate_decision", decisions.candidate_decision()).withColumn("off_decision", decisions.off_decision())), profiles_ready


def _control(spark: SparkSession, thresholds: DataFrame) -> DataFrame:
    """``profile, control_old, control``: whether a text that must alert does so at the old and at the candidate threshold."""
    known = features.profiles(spark)
    measured = features.compute_features(known.select("profile", F.lit(CONTROL).alias("text")), ENGLISH).drop("text", "style")
    rows = decisions.signal_rows(measured, known, decisions.signal_table(spark)).where(F.col("signal") == SIGNAL).drop("old")
    joined = rows.join(thresholds.select("profile", "old", "candidate"), "profile")
    return joined.select("profile", decisions.fires(F.col("old")).alias("control_old"), decisions.fires(F.col("candidate")).alias("control"))


_GATES = ", ".join(f"('{p}', {', '.join(str(x).lower() for x in g)})" for p, g in DIVERSITY_GATES.items())
_DECIDED = f"""with recursive {_JARGON.partition(", c as (select profile")[0].strip()},
q as (select s.*, text from s join documents using (doc_id)),
{_sql_split("profile", "q").strip()},
z as (select s.*, arm from s join comp on comp.doc_id = s.doc_id join arms on arms.g = s.profile and arms.component = comp.component),
by_source as (select profile, max(n) as n, max(w) as w, count(*) as kinds from (select profile, source, count(*) as n, sum(words) as w from s group by 1, 2) group by 1),
by_lang as (select profile, max(n) as n, max(w) as w, count(*) as kinds from (select profile, lang, count(*) as n, sum(words) as w from s group by 1, 2) group by 1),
size as (select profile, count(*) as docs, sum(words)::bigint as words, any_value(old)::double as old from s group by profile),
gate as (select size.*, size.docs >= {GATES["profile_documents"]} and size.words >= {GATES["profile_words"]} as size_met,
  a.kinds >= g.ls and b.kinds >= g.lc and a.n <= g.ms * size.docs and a.w <= g.mw * size.words and (not g.needed or (b.n <= g.ma * size.docs and b.w <= g.mx * size.words)) as diverse
  from size join by_source a using (profile) join by_lang b using (profile) join (values {_GATES}) g(profile, ls, lc, ms, mw, needed, least, ma, mx) using (profile)),
split as (select profile, count(*) filter (arm = 'calibration') as cd, coalesce(sum(words) filter (arm = 'calibration'), 0)::bigint as cw, count(*) filter (arm = 'validation') as vd, coalesce(sum(words) filter (arm = 'validation'), 0)::bigint as vw from z group by profile),
k as (select profile, greatest(any_value(old), quantile_cont(r_jargon, 0.95))::double as candidate from z where arm = 'calibration' group by profile),
e as (select gate.*, cd, cw, vd, vw, coalesce(candidate, old) as candidate, size_met and diverse as profile_met,
  size_met and diverse and docs >= {GATES["eligible_documents"]} and words >= {GATES["eligible_words"]} and cd >= {GATES["calibration_documents"]} and cw >= {GATES["calibration_words"]} and vd >= {GATES["validation_documents"]} and vw >= {GATES["validation_words"]} as evidence_gate
  from gate join split using (profile) left join k using (profile)),
a as (select z.doc_id, z.profile, n_jargon >= 4 and r_jargon >= z.old as old_fires, n_jargon >= 4 and r_jargon >= candidate as candidate_fires from z join e using (profile) where arm = 'validation'),
{_LABELS}, og as (select profile, {_SUMMARY} from a left join l using (doc_id) where old_fires group by profile),
x as (select profile, {_SUMMARY} from a left join l using (doc_id) where old_fires and not candidate_fires group by profile),
y as (select e.*, coalesce(og.alerts, 0) as alerts, coalesce(og.decisive, 0) as alerts_decisive, og.actionable_precision as p, coalesce(x.alerts, 0) as removed, coalesce(x.decisive, 0) as rd, coalesce(x.non_actionable, 0) as rn from e left join og using (profile) left join x using (profile)),
decided as (select *, case when not evidence_gate then 'blocked_evidence_gate_not_met' when candidate = old then 'keep_old_candidate_equals_old' when 1000 < candidate then 'keep_old_candidate_loses_positive_control' when removed < 10 then 'keep_old_candidate_effect_sample_too_small' when rd < 10 then 'candidate_blocked_needs_removed_alert_adjudication' when rn / rd::double >= 0.8 then 'candidate_supported_on_validation_pending_human_review' else 'keep_old_removed_alerts_include_too_many_actionable_cases' end as candidate_decision,
  case when not evidence_gate then 'off_blocked_evidence_gate_not_met' when alerts < 20 then 'off_not_evaluable_insufficient_natural_alert_sample' when alerts_decisive < 20 then 'off_blocked_needs_alert_adjudication' when p <= 0.25 then 'off_supported_by_low_actionable_precision_pending_human_review' else 'off_not_supported_signal_has_actionable_natural_alerts' end as off_decision from y)"""


@query(f"{_DECIDED} select profile, candidate_decision, off_decision from decided")
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0].select("profile", "candidate_decision", "off_decision")


@query(f"{_DECIDED} select profile, docs as eligible_documents, words as eligible_words, cd as calibration_documents, cw as calibration_words, vd as validation_documents, vw as validation_words, profile_met as profile_gate_met, evidence_gate from decided")
def evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0].select("profile", "eligible_documents", "eligible_words", "calibration_documents", "calibration_words", "validation_documents", "validation_words", "profile_gate_met", "evidence_gate")


@query(f"""{_DECIDED}, g as (select bool_and(profile_met) as p, bool_and(evidence_gate) as e, count(*) filter (candidate_decision = 'candidate_blocked_needs_removed_alert_adjudication' or off_decision = 'off_blocked_needs_alert_adjudication') as n from decided)
select p as all_profile_gates_met, e as all_applicable_signal_evidence_gates_met, n as natural_alert_adjudication_pending, p and e as ready_for_decision_evaluation, p and e and n = 0 as natural_alert_adjudication_complete_where_required, false as automatic_policy_update_allowed from g""")
def decision_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.readiness(*_decided(spark, sf_dir))


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).where("eligible")
    counts = alerts.groupBy("profile").agg(F.count(F.lit(1)).alias("eligible_documents"), F.sum("words").alias("eligible_words"), F.count_if("old_fires").alias("old_alerts"), F.count_if("candidate_fires").alias("candidate_alerts"), F.first("old").alias("old"), F.first("candidate").alias("candidate"))
    control = _control(spark, counts).withColumnRenamed("control", "control_candidate")
    gate = (F.col("eligible_documents") >= GATES["profile_documents"]) & (F.col("eligible_words") >= GATES["profile_words"])
    return counts.join(control, "profile").withColumn("decision", protocol.first_decision()).withColumn("freeze_gate_met", gate).withColumn("signal", F.lit(SIGNAL))


_FIRST = f"""with {_ALERTS}, t as (select a.profile, count(*) as n, sum(words)::bigint as w, count(*) filter (old_fires) as old_alerts, count(*) filter (candidate_fires) as candidate_alerts from a join r using (doc_id) group by a.profile),
u as (select t.*, c.old, c.candidate, n >= {GATES["profile_documents"]} and w >= {GATES["profile_words"]} as gate from t join c using (profile))"""


@query(f"""{_FIRST} select profile, n as eligible_documents, old_alerts, candidate_alerts, case when not gate then 'keep_old_freeze_gate_not_met' when candidate_alerts < old_alerts and 1000 >= candidate then 'candidate_eligible_for_activation' when old_alerts = 0 and 1000 >= old then 'keep_old_no_clean_noise_observed' when 1000 < candidate then 'keep_old_candidate_loses_positive_control' else 'keep_old_no_measured_gain' end as decision from u""")
def first_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).select("profile", "eligible_documents", "old_alerts", "candidate_alerts", "decision")


@query(f"""{_FIRST} select '{SIGNAL}' as signal, case when bool_or(candidate <> old) and bool_and(candidate = old or gate) then 'review_candidate_for_activation' when bool_or(candidate <> old) then 'do_not_activate_candidate_freeze_gate_not_met' else 'keep_old_no_evidence_for_threshold_change' end as overall_decision from u""")
def first_ladder_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.overall_decision(_first(spark, sf_dir))


_FLAGS = [f for f, *_ in protocol.WORKFLOW]


@query(f"""with b as (select doc_id, {", ".join(f"(doc_id // {2**i}) % 2 = 1 as {f}" for i, f in enumerate(_FLAGS))} from documents)
select doc_id, case {" ".join(f"when {'not ' * (not said)}{f} then {code}" for f, said, code, _ in protocol.WORKFLOW)} else 0 end as exit_code,
  case {" ".join(f"when {'not ' * (not said)}{f} then '{status}'" for f, said, _, status in protocol.WORKFLOW)} else '{protocol.COMPLETE[1]}' end as status from b""")
def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [((F.floor(F.col("doc_id") / 2**i) % 2) == 1).alias(f) for i, f in enumerate(_FLAGS)]
    docs = table(spark, sf_dir, "documents").select("doc_id", *flags).withColumn("s", protocol.workflow_state())
    return docs.select("doc_id", "s.exit_code", "s.status")


@query(f"with recursive d as (select doc_id, source, text, {_WORDS} as words from documents), {_sql_split('source', 'd').strip()} select g as source, component, arm from arms")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", T.token_count(F.col("text")).alias("words"), F.xxhash64("text").cast("string").alias("split_group"), F.col("source").alias("source_id")))
    return _components(docs, "source")[1]


@query(f"""with d as (select ['prose', 'oral', 'product', 'technical', 'official'][doc_id % 5 + 1] as profile, lower(trim(source)) as source, lower(trim(lang)) as lang, {_WORDS} as words from documents),
t as (select profile, count(*) as docs, sum(words) as words from d group by 1),
s as (select profile, count(*) as kinds, max(n) as n, max(w) as w from (select profile, source, count(*) as n, sum(words) as w from d group by 1, 2) group by 1),
c as (select profile, count(*) as kinds from (select distinct profile, lang from d) group by 1)
select profile, s.kinds as sources, c.kinds as channels, round_even(s.n / t.docs::double, 4) as source_document_share, round_even(s.w / t.words::double, 4) as source_word_share,
  s.kinds >= ls as minimum_sources, c.kinds >= lc as minimum_channels, s.n / t.docs::double <= ms as maximum_source_document_share, s.w / t.words::double <= mw as maximum_source_word_share,
  s.kinds >= ls and c.kinds >= lc and s.n / t.docs::double <= ms and s.w / t.words::double <= mw and (not needed or (s.n / t.docs::double <= ma and s.w / t.words::double <= mx)) as gate_met
from t join s using (profile) join c using (profile) join (values {_GATES}) g(profile, ls, lc, ms, mw, needed, least, ma, mx) using (profile)""")
def diversity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(_mode().alias("profile"), F.col("source").alias("source_id"), F.col("lang").alias("channel"), F.col("source").alias("author_or_group"), T.token_count(F.col("text")).alias("words"))
    return decisions.diversity_gate(docs).select("profile", "sources", "channels", "source_document_share", "source_word_share", "minimum_sources", "minimum_channels", "maximum_source_document_share", "maximum_source_word_share", "gate_met")


_KNOWN = ", ".join(f"'{s[0]}'" for s in SIGNALS)


@query(f"""with a as (select doc_id as document_id, case when doc_id % 3 = 0 then 'no-such-signal' else 'long-sentence' end as signal from labels)
select distinct document_id, signal from a where document_id not in (select doc_id from documents where lang = 'en') or signal not in ({_KNOWN})""")
def unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "no-such-signal").otherwise("long-sentence").alias("signal"))
    return decisions.unknown_references(said, english, decisions.signal_table(spark))


@query("""select doc_id, case when quality = 0 then 'bad' when toxic = 1 then 'uncertain' else 'non_actionable' end as label from labels where quality = 0""")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("quality") == 0, "bad").when(F.col("toxic") == 1, "uncertain").otherwise("non_actionable")
    return decisions.unknown_labels(table(spark, sf_dir, "labels").select("doc_id", said.alias("label")))


@query("""with recursive pool as (select doc_id, source, doc_id % 23 as year, row_number() over (order by sha256(doc_id::varchar)) as r, count(*) over () as n from documents),
steps as (select k * n + r as step, cap, doc_id, source, year from pool, (values (0, 1), (1, 2), (2, 3), (3, 5)) c(k, cap)),
fold(step, ids, authors, years) as (select 0::bigint, []::bigint[], []::varchar[], []::bigint[] union all
  select step, case when ok then list_append(ids, doc_id) else ids end, case when ok then list_append(authors, source) else authors end, case when ok then list_append(years, year) else years end from (
    select s.step, f.ids, f.authors, f.years, s.doc_id, s.source, s.year, len(f.ids) < 100 and not list_contains(f.ids, s.doc_id) and len(list_filter(f.authors, lambda a: a = s.source)) < s.cap and len(list_filter(f.years, lambda y: y = s.year)) < 5 as ok
    from fold f join steps s on s.step = f.step + 1)),
whole as (select ids from fold order by step desc limit 1)
select doc_id, source, doc_id % 23 as year, place::int as place from (select unnest(ids) as doc_id, generate_subscripts(ids, 1) as place from whole) join documents using (doc_id)""")
def capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 23).alias("year"))
    return protocol.capped_selection(pool, "doc_id", "source", "year")
