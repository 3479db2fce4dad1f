"""Verdicts and documents. A run is a customer, a check an order, a finding a line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.text import fnv1a32
from wardline.operators import report as R
from wardline.plans.registry import query
from wardline.sources.sinks import assert_no_raw

_STATUS = "case when o_orderpriority = '5-LOW' then 'skip' when o_orderstatus = 'F' then 'fail' when o_orderstatus = 'P' then 'warn' else 'pass' end"
_LABEL = "case o_orderpriority when '1-URGENT' then 'Secret scan' when '2-HIGH' then 'Tracked .env file' else 'Check ' || o_orderpriority end"
_CHECKS_SQL = f"checks as (select o_custkey as run_id, o_orderkey as \"check\", o_orderkey as pos, {_STATUS} as status, {_LABEL} as label, 'order ' || o_orderkey as detail, o_orderpriority as prio from orders)"
_FINDINGS_SQL = """findings as (select c.run_id, c."check", cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey as finding, case when c.prio = '1-URGENT' then 'aws' end as pattern_id,
  'src/part ' || l_partkey || '.ts' as file, 'fp' || l_suppkey as fp, sha256(cast(l_partkey as varchar)) as auth_id, l_linenumber as start_line, case when l_linenumber % 2 = 0 then 'message ' || l_partkey end as message
  from lineitem join checks c on l_orderkey = c."check")"""
_VERDICTS_SQL = """verdicts as (select run_id, count(*) filter (status = 'fail') as fails, count(*) filter (status = 'warn') as warns, count(*) filter (status = 'pass') as passes, count(*) filter (status = 'skip') as skips from checks group by run_id)"""
_RESULTS_SQL = f"""{_CHECKS_SQL}, {_FINDINGS_SQL}, {_VERDICTS_SQL},
joined as (select c.run_id, c."check", c.pos, coalesce(finding, 0) as finding, finding is null as own, c.label, c.detail, pattern_id, file, fp, auth_id, start_line, message,
  case when pattern_id is not null then 'secret/' || pattern_id when c.label = 'Secret scan' then 'check/secret-scan' when c.label = 'Tracked .env file' then 'check/tracked-env-file' else 'check/check-' || lower(replace(prio, ' ', '-')) end as rule_id,
  case when status = 'fail' then 'error' else 'warning' end as level from checks c left join findings f on c.run_id = f.run_id and c."check" = f."check" where status in ('fail', 'warn'))"""
_FNV = "printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(list_filter(string_split({s}, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"


def _checks(t):
    return t.orders.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("check"), F.col("o_orderkey").alias("pos"), F.expr(_STATUS).alias("status"),
        F.expr(_LABEL).alias("label"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("detail"), F.col("o_orderpriority").alias("prio"),
    )


def _described(rows):
    part, none = F.col("l_partkey").cast("string"), F.lit(None)
    found = F.col("finding").isNotNull()
    return rows.withColumns({
        "f_rule": none.cast("string"), "pattern_id": F.when(found & (F.col("prio") == "1-URGENT"), "aws"), "f_label": none.cast("string"),
        "file": F.concat(F.lit("src/part "), part, F.lit(".ts")), "fp": F.concat(F.lit("fp"), F.col("l_suppkey").cast("string")), "auth_id": F.sha2(part, 256),
        "start_line": F.col("l_linenumber"), "start_column": none.cast("int"), "end_column": none.cast("int"),
        "message": F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("message "), part)),
        "remediation": F.when(found, F.array(F.lit("remove it"), F.lit("rotate it"))),
    })


def _findings(t):
    """An order is of one customer, so its key alone finds the check."""
    number = F.col("l_linenumber") * F.lit(1000000000).cast("bigint") + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    items = t.lineitem.select(F.col("l_orderkey").alias("check"), number.alias("finding"), "l_partkey", "l_suppkey", "l_linenumber")
    return R.Findings(items, ("check",), _described)


@query(
    "verdict", "AGG1",
    f"""with {_CHECKS_SQL}, {_VERDICTS_SQL} select *, case when fails > 0 then 'NO-GO' else 'GO' end as verdict, case when fails > 0 then 1 else 0 end as exit_code,
    case when fails > 0 then 'failed: ' || fails when warns > 0 then 'to look at: ' || warns else 'nothing open' end as note from verdicts""",
)
def verdict(t):
    return R.verdict(_checks(t))


@query(
    "errored_checks", "AGG1",
    f"with {_CHECKS_SQL} select \"check\", case when run_id % 9 = 0 then 'fail' else status end as status, case when run_id % 9 = 0 then 'could not run: lost ' || run_id else detail end as detail from checks",
)
def errored_checks(t):
    error = F.when(F.col("run_id") % 9 == 0, F.concat(F.lit("lost "), F.col("run_id").cast("string")))
    return R.errored_is_fail(_checks(t).withColumn("error", error)).select("check", "status", "detail")


@query(
    "scoreboard", "AGG25",
    "select l.doc_id as id, case when quality = 1 then 'GO' else 'NO-GO' end as expected, case when d.doc_id % 13 = 0 then null when n_chars > 300 then 'GO' else 'NO-GO' end as observed, "
    "case when coalesce(case when d.doc_id % 13 = 0 then null when n_chars > 300 then 'GO' else 'NO-GO' end = case when quality = 1 then 'GO' else 'NO-GO' end, false) then 'GREEN' else 'RED' end as state from labels l join documents d using (doc_id)",
)
def scoreboard(t):
    expected = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "GO").otherwise("NO-GO").alias("expected"))
    observed = t.documents.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 300, "GO").otherwise("NO-GO").alias("observed"))
    return R.scoreboard(expected, observed)


_CASES = ["leak", "build-leak", "tracked-env", "clean", "dirty", "client-app", "server-map"]


@query(
    "acceptance_cases", "AGG25",
    """with c as (select doc_id, doc_id % 7 as k, case when doc_id % 7 in (0, 1) then text || ' sk_live_' || substr(sha256(cast(doc_id as varchar)), 1, 26) || ' ' else text end as body from documents),
    o as (select doc_id, ['leak','build-leak','tracked-env','clean','dirty','client-app','server-map'][k + 1] as judge, case when k = 5 then 'vite+react, 0 routes' when k = 6 then '2 routes, 1 open-write'
      when regexp_matches(body, 'sk_live_[0-9a-z]{26}') or k in (2, 4) then 'NO-GO' else 'GO' end as observed from c)
    select doc_id as id, judge, case judge when 'clean' then 'GO' when 'client-app' then 'vite+react, 0 routes' when 'server-map' then '2 routes, 1 open-write' else 'NO-GO' end as expected, observed,
      case when expected = observed then 'GREEN' else 'RED' end as state from o""",
)
def acceptance_cases(t):
    """Every document is a repo of one of seven judged kinds; its text lies in the file that is judged."""
    from wardline.operators import maps as M
    from wardline.operators import scope as S
    from wardline.operators.detect import detect
    from wardline.sources import files as sources

    k = F.col("doc_id") % 7
    key = F.concat(F.lit(" sk_live_"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(26)), F.lit(" "))
    docs = t.documents.select(F.col("doc_id").alias("repo"), k.alias("k"), F.when(k.isin(0, 1), F.concat("text", key)).otherwise(F.col("text")).alias("text"))
    path = F.when(F.col("k") == 1, "dist/bundle.js.map").when(F.col("k") == 2, ".env").otherwise("src/app.js")
    files = docs.select("repo", "k", path.alias("path"), "text")
    leaks = detect(files, "text", ["repo"]).select("repo").distinct().withColumn("status", F.lit("fail"))
    tracked = files.select("repo", "path", F.lit(True).alias("tracked"), F.lit(False).alias("ignored"))
    env = S.tracked_env_status(tracked).select("repo", "status")
    dirty = S.dirty_status(files.where("k = 4").select("repo", "path", F.lit(" M").alias("code"))).select("repo", "status")
    judged = R.verdict(leaks.unionByName(env).unionByName(dirty).withColumnRenamed("repo", "run_id"))
    safe = docs.where("k < 5").select("repo").join(judged.select(F.col("run_id").alias("repo"), "verdict"), "repo", "left").select("repo", F.coalesce("verdict", F.lit("GO")).alias("observed"))
    # maps: a client's manifest without routes, a server with two routes below the document's text in a comment
    manifest = docs.where("k = 5").select("repo", F.lit("package.json").alias("path"), F.lit('{"dependencies":{"vite":"5","react":"18"}}').alias("text"))
    stack = M.detect_stack(M.repo_facts(manifest.select("repo", "path"), sources.declared_deps(manifest), sources.package_states(manifest)))
    server = "\nconst app = require('express')();\napp.get('/items', (req, res) => res.json([]));\napp.post('/items', (req, res) => res.status(201).end());\n"
    commented = F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" */"))
    code = docs.where("k > 4").select("repo", F.lit("server.js").alias("path"), F.concat(commented, F.when(F.col("k") == 6, server).otherwise("")).alias("text"))
    surface = M.surface_summary(M.express_routes(code))
    counted = docs.where("k > 4").select("repo", "k").join(surface, "repo", "left").join(stack.select("repo", "label"), "repo", "left")
    routes = F.coalesce("routes", F.lit(0)).cast("string")
    seen = F.when(F.col("k") == 5, F.concat("label", F.lit(", "), routes, F.lit(" routes"))).otherwise(F.concat(routes, F.lit(" routes, "), F.col("dangerous").cast("string"), F.lit(" open-write")))
    expected = F.when(F.col("k") == 3, "GO").when(F.col("k") == 5, "vite+react, 0 routes").when(F.col("k") == 6, "2 routes, 1 open-write").otherwise("NO-GO")
    board = R.scoreboard(docs.select(F.col("repo").alias("id"), "k", expected.alias("expected")), safe.unionByName(counted.select("repo", seen.alias("observed"))).withColumnRenamed("repo", "id"))
    names = F.get(F.array(*[F.lit(c) for c in _CASES]), (F.col("id") % 7).cast("int"))
    return board.select("id", names.alias("judge"), "expected", "observed", "state")


@query("fnv1a", "FN5", "select page_id, " + _FNV.format(s="url") + " as hash from pages")
def fnv1a(t):
    return t.pages.select("page_id", fnv1a32(F.col("url")).alias("hash"))


@query(
    "rule_classes", "FLT12",
    f"""with {_RESULTS_SQL} select distinct rule_id, level, case level when 'error' then 'error' else 'warning' end as severity, rule_id like 'secret/%' or rule_id like 'check/tracked-env%' or label = 'Secret scan' as security from joined""",
)
def rule_classes(t):
    r = R.sarif_results(_checks(t), _findings(t))
    return r.select("rule_id", "level", R.problem_severity(F.col("level")).alias("severity"), "security").distinct()


@query(
    "sarif_results", "SNK4 FN5 FN6",
    f"""with {_RESULTS_SQL} select run_id, "check", finding, rule_id, level, case when own then label || ': ' || detail when message is not null then message else fp || ' — auth ' || auth_id end as message,
    replace(file, ' ', '%20') as uri, {_FNV.format(s="(case when own then rule_id || '|' || label || ': ' || detail else rule_id || '|' || file || '|' || fp || '|' || auth_id || '|' || start_line end)")} as fingerprint from joined""",
)
def sarif_results(t):
    return R.sarif_results(_checks(t), _findings(t)).select("run_id", "check", "finding", "rule_id", "level", "message", "uri", "fingerprint")


@query(
    "sarif_documents", "SNK4",
    f"""with {_RESULTS_SQL}, n as (select *, (row_number() over (partition by run_id order by pos, finding) - 1) // 25 as part from joined)
    select run_id, cast(part as int) as part, count(*) as results, count(distinct rule_id) as rules, case when any_value(fails) > 0 then 1 else 0 end as exit_code from n join verdicts using (run_id) group by run_id, part""",
)
def sarif_documents(t):
    checks = _checks(t)
    findings = _findings(t)
    docs = assert_no_raw(R.to_sarif(R.sarif_results(R.numbered_checks(checks, findings), findings, part_rows=25), R.verdict(checks), part_rows=25))
    runs = "$.runs[0]"
    return docs.select(
        "run_id", "part",
        F.json_array_length(F.get_json_object("sarif", runs + ".results")).cast("bigint").alias("results"),
        F.json_array_length(F.get_json_object("sarif", runs + ".tool.driver.rules")).cast("bigint").alias("rules"),
        F.get_json_object("sarif", runs + ".invocations[0].exitCode").cast("int").alias("exit_code"),
    )


def _listed(t):
    counted = t.lineitem.groupBy(F.col("l_orderkey").alias("check")).agg(F.count("*").alias("findings"))
    return _checks(t).join(counted, "check", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))


_LISTED_SQL = f"""{_CHECKS_SQL}, listed as (select c.*, coalesce(n, 0) as findings from checks c join orders o on c."check" = o.o_orderkey left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on l_orderkey = c."check"),
lv as (select run_id, case when count(*) filter (status = 'fail') > 0 or run_id % 10 = 3 then 1 else 0 end as code, count(*) filter (status = 'fail') > 0 as bad, string_agg('{{"status":"' || status || '","label":"' || label || '","detail":"' || detail || '","findings":' || findings || '}}', ',' order by pos) as items from listed group by run_id),
docs as (select run_id, code as exit_code, case when code = 0 then 'GO' else 'NO-GO' end as verdict, '{{"command":"check","verdict":"' || case when code = 0 then 'GO' else 'NO-GO' end || '","exitCode":' || code || ',"checks":[' || items || ']}}' as document from lv)"""


def _documents(t):
    checks = _listed(t)
    verdicts = R.verdict(checks)
    return R.run_document(checks, verdicts, verdicts.where("run_id % 10 = 3"))


@query("run_documents", "SNK6", f"with {_LISTED_SQL} select run_id, verdict, exit_code, document from docs")
def run_documents(t):
    return _documents(t)


@query(
    "ingest_bodies", "SNK7",
    f"""with {_LISTED_SQL}, b as (select run_id, '{{"project":{{"repo":"customer/' || run_id || '","name":"' || repeat('n', 300) || '"}},"kind":"check","verdict":"' || verdict || '","exitCode":' || exit_code as head, document from docs),
    c as (select *, strlen(head) + strlen(document) + 12 <= 900 as fits, case when strlen(head) + strlen(document) + 12 <= 900 then 1 else (length(document) + 149) // 150 end as parts from b),
    p as (select *, unnest(range(1, parts + 1)) as part from c)
    select run_id, cast(part as int) as part, cast(parts as int) as parts, case when fits then head || ',"payload":' || document || '}}'
      else head || ',"part":' || part || ',"parts":' || parts || ',"payload":' || to_json(substr(document, (part - 1) * 150 + 1, 150))::varchar || '}}' end as body from p""",
)
def ingest_bodies(t):
    return R.ingest_body(_documents(t), F.concat(F.lit("customer/"), F.col("run_id").cast("string")), F.repeat(F.lit("n"), 300), max_bytes=900, part_chars=150)


_PLAN_SQL = f"""{_CHECKS_SQL}, n as (select l_orderkey, count(*) as n from lineitem group by l_orderkey), c as (select ch.*, coalesce(n, 0) as findings from checks ch left join n on l_orderkey = "check" where status in ('fail','warn')),
r as (select *, row_number() over (partition by run_id order by (status <> 'fail')::int, pos) as rank from c), b as (select *, coalesce(sum(least(findings, 8)) over (partition by run_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from r where rank <= 12),
plan as (select run_id, "check", rank, least(findings, 8, 20 - before) as shown, findings - least(findings, 8, 20 - before) as more from b where before < 20)"""


def _counted(t):
    counted = t.lineitem.groupBy(F.col("l_orderkey").alias("check")).agg(F.count("*").alias("findings"))
    return _checks(t).join(counted, "check", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))


@query("blocking_first", "SRT5", f"with {_CHECKS_SQL} select run_id, \"check\", row_number() over (partition by run_id order by (status <> 'fail')::int, pos) as rank from checks where status in ('fail','warn')")
def blocking_first(t):
    return R.blocking_first(_checks(t)).select("run_id", "check", "rank")


@query("summary_plan", "W8", f'with {_PLAN_SQL} select run_id, "check", rank, cast(shown as bigint) as shown, cast(more as bigint) as more from plan')
def summary_plan(t):
    return R.summary_plan(_counted(t)).select("run_id", "check", "rank", "shown", "more")


_CELL = "coalesce('src/part ' || l_partkey || '.ts:' || start_line || ' · ' || fp || coalesce(' · ' || message, '') || ' · auth ' || auth_id, c.detail)"


@query(
    "summary_rows", "SNK8 W8",
    f"""with {_CHECKS_SQL}, {_FINDINGS_SQL.replace("as file,", "as file, l_partkey,")}, r as (select *, row_number() over (partition by run_id order by (status <> 'fail')::int, pos) as rank from checks where status in ('fail', 'warn'))
    select c.run_id, c."check", rank, finding, status, label as label_cell, {_CELL} as detail_cell from r c left join findings f on c.run_id = f.run_id and c."check" = f."check\"""",
)
def summary_rows(t):
    """Every finding of every run as a line of the summary, whole."""
    return R.summary_rows(_checks(t), _findings(t))


@query(
    "summary_markdown", "SNK8 W8",
    f"""with {_PLAN_SQL}, {_FINDINGS_SQL.replace("as file,", "as file, l_partkey,")}, nf as (select *, row_number() over (partition by run_id, "check" order by finding) as r from findings),
    rows as (select p.run_id, p.rank, coalesce(r, 0) as r, c.label, '| ' || case c.status when 'fail' then 'FAIL' else 'WARN' end || ' | ' || left(c.label, 80) || ' | ' as head, left({_CELL}, 240) as detail, more, shown, r is not null as has from plan p join checks c using (run_id, "check")
      left join nf f on f.run_id = p.run_id and f."check" = p."check" and f.r <= 8 where r is null or r <= shown),
    lines as (select *, head || detail || ' |' || case when more > 0 and r >= shown then chr(10) || head || 'and ' || more || ' more |' else '' end as line, case when has then '- ' || left(label, 80) || chr(10) || '  remove it' || chr(10) || '  rotate it' end as fix,
      count(*) filter (has) over (partition by run_id order by rank, r) as nth from rows),
    pages as (select run_id, string_agg(line, chr(10) order by rank, r) as lines, string_agg(fix, chr(10) order by rank, r) filter (has and nth <= 5) as fixes, count(distinct rank) as shown_checks from lines group by run_id),
    all_runs as (select run_id, count(*) filter (status in ('fail','warn')) as interesting, count(*) filter (status = 'fail') > 0 as bad from checks group by run_id),
    bodies as (select run_id, interesting, '### check' || chr(10) || chr(10) || '**' || case when bad then 'NO-GO** · exit `1`' else 'GO** · exit `0`' end || chr(10) || chr(10) ||
      case when interesting = 0 then 'Nothing failed.' else '| Status | Check | Detail |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines end
      || case when interesting > coalesce(shown_checks, 0) then chr(10) || chr(10) || 'Checks not listed here: ' || (interesting - coalesce(shown_checks, 0)) else '' end
      || case when fixes is not null then chr(10) || chr(10) || '**What to do**' || chr(10) || fixes else '' end || chr(10) as body from all_runs left join pages using (run_id))
    select run_id, interesting, body from bodies""",
)
def summary_markdown(t):
    return R.summary_markdown(_counted(t), _findings(t), R.verdict(_checks(t)))


@query(
    "top_languages", "W7",
    "select source, lang, rank from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as rank from documents group by source, lang) where rank <= 2",
)
def top_languages(t):
    counted = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return R.top_n(counted, ["source"], [F.desc("n"), "lang"], 2).select("source", "lang", "rank")


@query(
    "capped_lists", "SRT3",
    "with d as (select distinct l_returnflag as flag, l_partkey as part from lineitem), r as (select *, row_number() over (partition by flag order by part) as rn from d) select flag, string_agg(cast(part as varchar), ',' order by part) filter (rn <= 10) as items, greatest(count(*) - 10, 0) as more from r group by flag",
)
def capped_lists(t):
    parts = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    out = R.capped_list(parts, ["flag"], "part", 10)
    return out.select("flag", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "more")


_TYPED = "case c_custkey % 4 when 0 then lower(substr({n},1,2) || substr({n},4)) when 1 then lower({n} || 'xx') when 2 then lower(substr({n},1,4)) else 'zz' || c_custkey % 7 end"


@query(
    "did_you_mean", "JN16",
    f"""with typed as (select distinct {_TYPED.format(n='n_name')} as typed from customer join nation on c_nationkey = n_nationkey), w as (select distinct lower(n_name) as w from nation),
    s as (select typed, w, levenshtein(typed, w) as d, starts_with(w, typed) as p from typed, w),
    b as (select *, row_number() over (partition by typed order by d, w) as rn from s where d <= 2 or p)
    select t.typed, w as suggestion from typed t left join b on t.typed = b.typed and rn = 1""",
)
def did_you_mean(t):
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    values = named.select(F.expr(_TYPED.format(n="n_name")).alias("typed"))
    return R.did_you_mean(values, "typed", t.nation.select(F.lower("n_name").alias("w")), "w")
