"""Repeated blocks, sizes, churn and the ranking built from them.

A repo is a document's source, a path its language and id; commits are orders
(repo = order priority) and touched paths their parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import fixed_values as V
from wardline.functions.text import collapse_score, line_count, move_case, normalized_lines
from wardline.operators import duplication as A
from wardline.plans.registry import QUERIES, query

# Documents are short; windows of five lines repeat in them as fifteen-line windows do in code.
K = 5

_LINES_CTE = r"""raw as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as n from (select doc_id, string_split(text, chr(10)) as l from documents)),
tidy as (select doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) as norm from raw),
lines as (select doc_id, n, norm, row_number() over (partition by doc_id order by n) - 1 as pos from tidy where length(norm) >= 4 and not starts_with(norm, '//')
  and not starts_with(norm, '#') and not starts_with(norm, '*') and not starts_with(norm, '/*') and not regexp_matches(norm, '^[{}()\[\];,.:]+$')
  and not regexp_matches(norm, '^(import\b|export \{[^}]*\} from\b|export \* from\b|from \S+ import\b|using \S|package \S|require\s*\()'))"""
_WINDOWS_CTE = f"""{_LINES_CTE},
windows as (select doc_id, pos, n as line_from, last_n as line_to, win from (select doc_id, pos, n, lead(n, {K - 1}) over w as last_n, list(norm) over (partition by doc_id order by pos rows between current row and {K - 1} following) as win
  from lines window w as (partition by doc_id order by pos)) where len(win) = {K}),
hot as (select win, count(*) as occurrences from windows group by win having count(*) >= 3),
members as (select w.* from windows w join hot using (win))"""
_BLOCKS_CTE = f"""{_WINDOWS_CTE},
starts as (select distinct doc_id, pos, line_from, line_to from members),
marked as (select *, case when pos - lag(pos) over (partition by doc_id order by pos) <= {K} then 0 else 1 end as opens from starts),
numbered as (select *, sum(opens) over (partition by doc_id order by pos) as block from marked),
blocks as (select doc_id, cast(block as int) as block, min(line_from) as line_from, max(line_to) as line_to from numbered group by doc_id, block)"""


def _windows(t):
    return A.line_windows(t.documents, "text", ["doc_id"], K)


@query("normalized_lines", "FN8", f"with {_LINES_CTE} select doc_id, n as line, norm from lines")
def normalized_lines_query(t):
    return t.documents.select("doc_id", F.inline(normalized_lines(F.col("text"))))


@query("line_windows", "W1", f"with {_WINDOWS_CTE} select doc_id, pos, line_from, line_to from windows")
def line_windows_query(t):
    return _windows(t).select("doc_id", "pos", "line_from", "line_to")


@query("hot_windows", "AGG4 W1", f"with {_WINDOWS_CTE} select occurrences, count(*) as windows from hot group by occurrences")
def hot_windows_query(t):
    return A.hot_windows(_windows(t)).groupBy("occurrences").agg(F.count("*").alias("windows"))


@query("duplicate_blocks", "W2", f"with {_BLOCKS_CTE} select doc_id, block, line_from, line_to from blocks")
def duplicate_blocks(t):
    return A.merge_blocks(A.hot_members(_windows(t)), ["doc_id"], K)


_SHARED_CTE = f"""{_WINDOWS_CTE}, occ as (select distinct win, doc_id from members), spread as (select win, count(*) as files, min(doc_id) as first from occ group by win)"""


@query(
    "shared_with", "JN11",
    f"""with recursive {_SHARED_CTE}, near as (select distinct o.doc_id as a, s.first as b from occ o join spread s using (win)),
    ways as (select a, b from near union select b, a from near),
    walk as (select distinct a as node, a as seen from ways union select w.node, x.b from walk w join ways x on w.seen = x.a),
    roots as (select node, min(seen) as root from walk group by node)
    select doc_id, root as class, cast(count(*) over (partition by root) as bigint) as class_files, hot_windows, shared_windows, shared_files from
      (select doc_id, count(*) as hot_windows, count(*) filter (files > 1) as shared_windows, cast(sum(files - 1) as bigint) as shared_files from occ join spread using (win) group by doc_id) join roots on doc_id = node""",
)
def shared_with_query(t):
    return A.shared_with(A.hot_members(_windows(t)), ["doc_id"]).withColumn("class", F.col("class.doc_id"))


@query("shared_members", "JN11", f"with {_SHARED_CTE} select doc_id, cast(files as bigint) as files, count(*) as windows from occ join spread using (win) group by all")
def shared_members_query(t):
    """Every file's memberships, added up by how many files share a window."""
    return A.shared_members(A.hot_members(_windows(t)), ["doc_id"]).groupBy("doc_id", "files").agg(F.count("*").alias("windows"))


# --- churn ----------------------------------------------------------------------------------------

_COMMITS_CTE = """commits as (select o_orderpriority as repo, o_orderkey as commit, o_orderdate as ts from orders),
touches as (select o_orderpriority as repo, o_orderkey as commit, 'part' || l_partkey as path from lineitem join orders on l_orderkey = o_orderkey),
recent as (select * from (select *, row_number() over (partition by repo order by ts desc, commit desc) as rn from commits) where rn <= 100),
churned as (select t.repo, t.path, count(*) as churn from touches t join recent r on t.repo = r.repo and t.commit = r.commit group by all)"""


def _commits(t):
    return t.orders.select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))


def _touches(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("path"))
    return items.join(_commits(t).select("repo", "commit"), "commit")


@query("newest_commits", "SRT2", f'with {_COMMITS_CTE} select repo, commit from recent')
def newest_commits_query(t):
    return A.newest_commits(_commits(t), V.CHURN_COMMITS).select("repo", "commit")


@query("churn", "AGG2", f"with {_COMMITS_CTE} select repo, path, churn from churned")
def churn_query(t):
    return A.churn(_commits(t), _touches(t), V.CHURN_COMMITS)


# --- size, metrics, ranking ----------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# A part is a file: its size in lines grows with p_size and price.
_FILES_CTE = f"""{_COMMITS_CTE},
sizes as (select {PRIORITIES}[p_partkey % 5 + 1] as repo, 'part' || p_partkey as path, cast(p_size * 40 + p_partkey % 300 as int) as lines from part),
tiered as (select *, case when lines > 1800 then 'flag' when lines > 1000 then 'warn' when lines > 600 then 'notice' end as size_tier from sizes),
dup as (select o_orderpriority as repo, 'part' || l_partkey as path, count(*) as duplicate_blocks from lineitem join orders on l_orderkey = o_orderkey where l_quantity = 50 and l_discount = 0.05 group by all),
metrics as (select s.*, coalesce(c.churn, 0) as churn, coalesce(d.duplicate_blocks, 0) as duplicate_blocks from tiered s left join churned c using (repo, path) left join dup d using (repo, path)),
scored as (select *, floor((lines / 100.0) * (1 + sqrt(churn)) * (1 + 2 * duplicate_blocks) * 10 + 0.5) / 10 as score from metrics)"""
_CANDIDATE = "(lines > 600 or duplicate_blocks > 0 or (churn >= 10 and lines >= 300))"


def _sizes(t):
    from wardline.functions.text import size_tier

    repos = F.array(*[F.lit(r) for r in PRIORITIES])
    sized = t.part.select(
        F.get(repos, (F.col("p_partkey") % 5).cast("int")).alias("repo"),
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("path"),
        (F.col("p_size") * 40 + F.col("p_partkey") % 300).cast("int").alias("lines"),
    )
    return sized.withColumn("size_tier", size_tier(F.col("lines")))


def _blocks(t):
    wide = t.lineitem.where("l_quantity = 50 and l_discount = 0.05").select(
        F.col("l_orderkey").alias("commit"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("path")
    )
    return wide.join(_commits(t).select("repo", "commit"), "commit").select("repo", "path")


def _metrics(t):
    return A.file_metrics(_sizes(t), A.churn(_commits(t), _touches(t), V.CHURN_COMMITS), _blocks(t), ["repo", "path"])


@query("file_metrics", "JN4", f"with {_FILES_CTE} select repo, path, lines, size_tier, churn, duplicate_blocks from metrics")
def file_metrics_query(t):
    return _metrics(t)


@query("collapse_candidates", "SRT1 FN25", f"with {_FILES_CTE} select repo, path, lines, churn, duplicate_blocks, score from scored where {_CANDIDATE} order by score desc, lines desc, repo, path limit 10")
def collapse_candidates_query(t):
    return A.collapse_candidates(_metrics(t), ["repo", "path"]).select("repo", "path", "lines", "churn", "duplicate_blocks", "score")


@query(
    "collapse_scores", "FN25",
    f"""with {_FILES_CTE} select repo, path, score, case when lines > 600 and churn >= 10 and duplicate_blocks > 0 then 'big_hot_dup'
      when lines > 600 and churn >= 10 then 'big_hot' when lines > 600 and duplicate_blocks > 0 then 'big_dup' when duplicate_blocks > 0 then 'dup'
      when lines > 600 then 'big' else 'churn' end as move from scored""",
)
def collapse_scores(t):
    m = _metrics(t)
    score = collapse_score(F.col("lines"), F.col("churn"), F.col("duplicate_blocks"))
    move = move_case(F.col("lines"), F.col("churn"), F.col("duplicate_blocks"))
    return m.select("repo", "path", score.alias("score"), move.alias("move"))


@query(
    "accretion_band", "AGG6",
    f"""with {_FILES_CTE} select repo, count(*) as files, count(*) filter (size_tier = 'notice') as notice, count(*) filter (size_tier = 'warn') as warn, count(*) filter (size_tier = 'flag') as flag,
    cast(sum(duplicate_blocks) as bigint) as duplicate_blocks, count(*) filter (churn >= 10) as hot_files, count(*) filter {_CANDIDATE.replace('(lines', '(lines', 1)} as candidates,
    case when count(*) filter (size_tier = 'flag') > 0 or bool_or(coalesce(size_tier = 'warn' and churn >= 10, false)) or sum(duplicate_blocks) >= 5 then 'severe'
      when count(*) filter {_CANDIDATE} > 0 then 'notable' else 'quiet' end as band from metrics group by repo""",
)
def accretion_band_query(t):
    return A.accretion_band(_metrics(t), ["repo"])


# The same over documents as files: lines from line_counts, blocks from the windows of their texts.
_DOCUMENT_FILES_CTE = f"""{_COMMITS_CTE}, {_BLOCKS_CTE},
sizes as (select doc_id, {PRIORITIES}[doc_id % 5 + 1] as repo, 'part' || doc_id as path, cast((length(text) - length(replace(text, chr(10), '')) + 1) * case when doc_id % 7 = 0 then 300 when doc_id % 4 = 0 then 60 else 1 end as int) as lines from documents),
tiered as (select *, case when lines > 1800 then 'flag' when lines > 1000 then 'warn' when lines > 600 then 'notice' end as size_tier from sizes),
dup as (select doc_id, count(*) as duplicate_blocks from blocks group by doc_id),
metrics as (select s.* exclude (doc_id), coalesce(c.churn, 0) as churn, coalesce(d.duplicate_blocks, 0) as duplicate_blocks from tiered s left join churned c using (repo, path) left join dup d using (doc_id)),
scored as (select *, floor((lines / 100.0) * (1 + sqrt(churn)) * (1 + 2 * duplicate_blocks) * 10 + 0.5) / 10 as score from metrics)"""


def _over_documents(name: str) -> str:
    return QUERIES[name].sql.replace(_FILES_CTE, _DOCUMENT_FILES_CTE)


def _document_metrics(t):
    from wardline.functions.text import size_tier

    repos = F.array(*[F.lit(r) for r in PRIORITIES])
    file = (F.get(repos, (F.col("doc_id") % 5).cast("int")).alias("repo"), F.concat(F.lit("part"), F.col("doc_id").cast("string")).alias("path"))
    # some texts stand for files that hold them many times over, so that files of every size occur
    times = F.when(F.col("doc_id") % 7 == 0, 300).when(F.col("doc_id") % 4 == 0, 60).otherwise(1)
    lines = line_count(F.concat("text", F.lit("\n"))) * times
    sizes = t.documents.select(*file, lines.cast("int").alias("lines")).withColumn("size_tier", size_tier(F.col("lines")))
    blocks = duplicate_blocks(t).select(*file)
    return A.file_metrics(sizes, A.churn(_commits(t), _touches(t), V.CHURN_COMMITS), blocks, ["repo", "path"])


@query("document_metrics", "JN4", _over_documents("file_metrics"))
def document_metrics_query(t):
    return _document_metrics(t)


@query("document_candidates", "SRT1 FN25", _over_documents("collapse_candidates"))
def document_candidates_query(t):
    return A.collapse_candidates(_document_metrics(t), ["repo", "path"]).select("repo", "path", "lines", "churn", "duplicate_blocks", "score")


@query("document_scores", "FN25", _over_documents("collapse_scores"))
def document_scores(t):
    m = _document_metrics(t)
    score = collapse_score(F.col("lines"), F.col("churn"), F.col("duplicate_blocks"))
    move = move_case(F.col("lines"), F.col("churn"), F.col("duplicate_blocks"))
    return m.select("repo", "path", score.alias("score"), move.alias("move"))


@query("document_accretion_band", "AGG6", _over_documents("accretion_band"))
def document_accretion_band(t):
    return A.accretion_band(_document_metrics(t), ["repo"])


@query(
    "severe_hotspots", "AGG7",
    f"with {_FILES_CTE} select count(*) filter (lines > 1800 or (lines > 1000 and churn >= 1 and churn >= 10)) as severe_hotspots from metrics",
)
def severe_hotspots_query(t):
    return A.severe_hotspots(_sizes(t), A.churn(_commits(t), _touches(t), V.CHURN_COMMITS), ["repo", "path"])


@query(
    "line_counts", "AGG3 FLT9",
    """select doc_id, cast(length(text) - length(replace(text, chr(10), '')) + case when ends_with(text, chr(10)) then 0 else 1 end as int) as lines,
    len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 5000)) > 0 as generated,
    case when not generated then case when lines > 1800 then 'flag' when lines > 1000 then 'warn' when lines > 600 then 'notice' end end as size_tier from documents""",
)
def line_counts_query(t):
    return A.line_counts(t.documents, "text", ["doc_id"])


# --- complexity ---------------------------------------------------------------------------------------------

_CODE = (
    "'function f' || {id} || '(a, b, c, d, e, f) {{ if (a && b) {{ for (;;) {{ ' || repeat('{{', cast({id} % 7 as int)) || ' \"}}}}{{{{\" ' || repeat('}}', cast({id} % 7 as int)) || ' }} }} }}' || chr(10)"
    " || '/* {{{{{{ */ const g = (x, y) => x || y; // {{{{' || chr(10) || repeat('while (x) {{ y(); }}' || chr(10), cast({id} % 5 as int))"
)


@query(
    "complexity", "AGG5",
    "select doc_id, cast(3 + doc_id % 7 as int) as max_nesting, 1 as many_param_fns, cast(floor((4.0 + doc_id % 5) / (2 + doc_id % 5) * 100 + 0.5) as int) as branches_per_100 from documents",
)
def complexity_query(t):
    code = F.expr(_CODE.format(id="doc_id"))
    norm = line_count(code)
    return t.documents.select("doc_id", A.complexity(code, norm).alias("c")).select("doc_id", "c.*")
