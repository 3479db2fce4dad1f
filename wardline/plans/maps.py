"""Route, integration, schedule and stack maps.

Source files are planted per page (its id picks one of eight shapes), manifests per
customer, file contents per document; every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import maps as M
from wardline.plans.registry import query
from wardline.sources import files as S

# (path, text) of each shape; ID is the page id.
SHAPES = [
    ("src/s_ID.js", "const app = x();\napp.get('/p/ID', requireAuth, h);\napp.post(\"/p/ID\", h);\nconst s = \"app.put('/no', h)\"; // app.delete('/c', h)\nrouter.get(path, h);\n"),
    ("src/t_ID.ts", "router.route('/c/ID').get(h).post(verifyToken, h);\nfastify.route({ method: ['GET','PUT'], url: '/o/ID', preHandler: authenticate });\n/* app.get('/no', h) */\n"),
    ("api/v_ID.py", "@app.route(\"/f/ID\", methods=[\"POST\", \"GET\"])\n@login_required\ndef f():\n    pass\n\n@app.route(\"/g/ID\")\ndef g():\n    pass\n# @app.route(\"/no\")\nx = \"@app.get('/no')\"\n"),
    ("api/w_ID.py", "@router.post(\"/i/ID\")\ndef create(item,\n    user=Depends(get_current_user)):\n    pass\n\n\n@router.delete(\"/j/ID\")\ndef read():\n    pass\n@router.get(name)\ndef z():\n    pass\n"),
    ("app/api/x/ID/route.ts", "export async function POST(req) { currentAccount(); }\nexport const GET = h;\n"),
    ("src/app/api/cron/ID/route.ts", "export function GET() { if (x !== process.env.CRON_SECRET) return 1 }\n"),
    ("app/api/y/ID/route.ts", "// currentAccount\nexport { h as DELETE }\n"),
    ("app/c_ID.tsx", "// note\n\"use client\"\nconst k = process.env.OPENAI_API_KEY; const p = process.env.NEXT_PUBLIC_TOKEN; const k2 = process.env.OPENAI_API_KEY;\nfetch(\"https://api.stripe.com/v1\");\nimport s from \"openai\";\n"),
]


def _sources(t):
    i = F.col("page_id").cast("string")
    pick = lambda n: F.replace(F.get(F.array(*[F.lit(s[n]) for s in SHAPES]), (F.col("page_id") % 8).cast("int")), F.lit("ID"), i)
    return t.pages.select(
        F.concat(F.lit("r"), (F.col("page_id") % 16).cast("string")).alias("repo"), pick(0).alias("path"), pick(1).alias("text"), "page_id"
    )


def _route_rows(cases: list[tuple]) -> str:
    """(shape, url, methods, mutates, session, secret) as SQL over pages."""
    return " union all ".join(
        f"select 'r' || page_id % 16 as repo, '{u}' || page_id || '{tail}' as url, '{m}' as methods, {mu} as mutates, {se} as session_gated, {sc} as secret_gated, false as dev_only from pages where page_id % 8 = {s}"
        for s, u, tail, m, mu, se, sc in cases
    )


_NODE = [
    (0, "/p/", "", "GET", "false", "true", "false"), (0, "/p/", "", "POST", "true", "false", "false"),
    (1, "/c/", "", "GET,POST", "true", "true", "false"), (1, "/o/", "", "GET,PUT", "true", "true", "false"),
]
_PYTHON = [
    (2, "/f/", "", "POST,GET", "true", "true", "false"), (2, "/g/", "", "GET", "false", "false", "false"),
    (3, "/i/", "", "POST", "true", "true", "false"), (3, "/j/", "", "DELETE", "true", "false", "false"),
]
_NEXT = [
    (4, "/api/x/", "", "GET,POST", "true", "true", "false"), (5, "/api/cron/", "", "GET", "false", "false", "true"),
    (6, "/api/y/", "", "DELETE", "true", "false", "false"),
]


def _flat(routes):
    return routes.withColumn("methods", F.array_join("methods", ","))


@query("express_routes", "FN12 SET4", _route_rows(_NODE))
def express_routes(t):
    return _flat(M.express_routes(_sources(t)))


@query("python_routes", "FN13", _route_rows(_PYTHON))
def python_routes(t):
    return _flat(M.python_routes(_sources(t)))


@query("api_surface", "FN10 FN11", _route_rows(_NEXT))
def api_surface(t):
    return _flat(M.api_surface(_sources(t)))


@query("dynamic_routes", "FN12 FN13", "select 'r' || page_id % 16 as repo, count(*) as dynamic from pages where page_id % 8 in (0, 3) group by 1")
def dynamic_routes(t):
    return M.dynamic_routes(_sources(t))


_ALL = _route_rows(_NODE + _PYTHON + _NEXT)


def _all_routes(t):
    stacks = _sources(t).select(
        "repo", F.when(F.col("page_id") % 8 < 2, "node").when(F.col("page_id") % 8 < 4, "python").when(F.col("page_id") % 8 < 7, "next").otherwise("go").alias("kind")
    ).distinct()
    return M.scan_routes(_sources(t), stacks)


@query("scan_routes", "FN14 SET4 SRT4", _ALL)
def scan_routes(t):
    return _flat(M.sorted_routes(M.distinct_registrations(_all_routes(t))))


@query(
    "surface_summary", "AGG13",
    f"select repo, count(*) as routes, count(*) filter (session_gated or secret_gated) as gated, count(*) filter (mutates) as mutating, count(*) filter (mutates and not session_gated and not secret_gated) as dangerous from ({_ALL}) group by repo",
)
def surface_summary(t):
    return M.surface_summary(_all_routes(t))


@query(
    "route_tags", "AGG13",
    f"select url, methods, case when session_gated then 'session' when secret_gated then 'secret' when mutates then 'open-write' else 'open-read' end as tag from ({_ALL})",
)
def route_tags(t):
    return _flat(_all_routes(t)).select("url", "methods", M.route_tag().alias("tag"))


@query("client_secret_reads", "FLT15 FLT17", "select 'r' || page_id % 16 as repo, 'app/c_' || page_id || '.tsx' as path, 'OPENAI_API_KEY' as key from pages where page_id % 8 = 7")
def client_secret_reads(t):
    return M.client_secret_reads(_sources(t))


_HOSTS_SQL = (
    "hosts as (select 'r' || page_id % 16 as repo, 'app/c_' || page_id || '.tsx' as file, unnest(['Stripe (HTTP)', 'OpenAI (SDK)']) as label, unnest(['STRIPE_SECRET_KEY', 'OPENAI_API_KEY']) as keys from pages where page_id % 8 = 7)"
)


@query("integrations_by_host", "JN6", f"with {_HOSTS_SQL} select * from hosts")
def integrations_by_host(t):
    return M.integrations_by_host(_sources(t)).withColumn("keys", F.array_join("keys", ","))


# --- manifests: one repo per customer ----------------------------------------------------------------------------

MANIFESTS = [
    ("package.json", '{"dependencies":{"express":"^4","openai":"1","@anthropic-ai/bedrock":"0"},"devDependencies":{"typescript":"5"}}'),
    ("package.json", '{"dependencies":{"react":"^19","@supabase/supabase-js":"2"},"devDependencies":{"vite":"^5"}}'),
    ("package.json", '{"dependencies":{"next":"15","stripe":"1"}}'),
    ("package.json", '{"dependencies": {broken'),
    ("requirements.txt", "# comment\n-r base.txt\nFlask==2.0\nopenai>=1\nlangchain-core\n"),
    ("pyproject.toml", '[project]\ndependencies = [\n  "fastapi>=0.1",\n  "boto3"\n]\n'),
    ("go.mod", "module x\n"),
]


def _manifests(t):
    i = (F.col("c_custkey") % len(MANIFESTS)).cast("int")
    return t.customer.select(
        F.col("c_custkey").alias("repo"), F.get(F.array(*[F.lit(m[0]) for m in MANIFESTS]), i).alias("path"), F.get(F.array(*[F.lit(m[1]) for m in MANIFESTS]), i).alias("text")
    )


_DEPS_SQL = """deps as (select c_custkey as repo, unnest([['express','openai','@anthropic-ai/bedrock','typescript'], ['react','@supabase/supabase-js','vite'], ['next','stripe'], [], ['flask','openai','langchain-core'], ['fastapi','boto3'], []][c_custkey % 7 + 1]) as dep,
  case when c_custkey % 7 < 3 then 'node' else 'python' end as ecosystem, ['package.json','package.json','package.json','','requirements.txt','pyproject.toml',''][c_custkey % 7 + 1] as source from customer)"""


@query("declared_deps", "SRC10", f"with {_DEPS_SQL} select * from deps")
def declared_deps(t):
    return S.declared_deps(_manifests(t))


_FOUND_SQL = f"""{_DEPS_SQL}, found as (select repo, source || ' (declared dependency)' as file, case dep when 'openai' then 'OpenAI (SDK)' when '@anthropic-ai/bedrock' then 'Anthropic (SDK)' when '@supabase/supabase-js' then 'Supabase (SDK)' when 'stripe' then 'Stripe (SDK)' when 'langchain-core' then 'LangChain' when 'boto3' then 'AWS (boto3)' end as label,
  case dep when 'openai' then 'OPENAI_API_KEY' when '@anthropic-ai/bedrock' then 'ANTHROPIC_API_KEY' when '@supabase/supabase-js' then 'SUPABASE_URL,SUPABASE_ANON_KEY' when 'stripe' then 'STRIPE_SECRET_KEY' when 'boto3' then 'AWS_ACCESS_KEY_ID' else '' end as keys from deps)"""


@query("integrations_by_dependency", "JN5", f"with {_FOUND_SQL} select * from found where label is not null")
def integrations_by_dependency(t):
    return M.integrations_by_dependency(S.declared_deps(_manifests(t))).withColumn("keys", F.array_join("keys", ","))


@query(
    "integration_rollup", "AGG14",
    f"with {_FOUND_SQL} select cast(repo % 5 as varchar) as repo, label, count(distinct file) as files, array_to_string(list_sort(list_distinct(flatten(list(case when keys = '' then [] else string_split(keys, ',') end)))), ',') as keys from found where label is not null group by 1, 2",
)
def integration_rollup(t):
    found = M.integrations_by_dependency(S.declared_deps(_manifests(t))).withColumn("repo", (F.col("repo") % 5).cast("string"))
    return M.integration_rollup(found).withColumn("keys", F.array_join("keys", ","))


def _facts(t):
    m = _manifests(t)
    extra = t.customer.select(
        F.col("c_custkey").alias("repo"), F.get(F.array(F.lit("tsconfig.json"), F.lit("vite.config.ts"), F.lit("index.html")), (F.col("c_custkey") % 3).cast("int")).alias("path")
    )
    files = m.select("repo", "path").unionByName(extra)
    return M.repo_facts(files, S.declared_deps(m), S.package_states(m))


@query(
    "detect_stack", "FN15",
    """select c_custkey as repo, ['node','node','next','node','python','python','go'][c_custkey % 7 + 1] as kind,
    ['express','vite+react','next','unreadable-manifest','flask','fastapi','plain'][c_custkey % 7 + 1] as label,
    c_custkey % 7 = 1 as frontend, c_custkey % 7 = 0 and c_custkey % 3 = 0 as typecheckable, case when c_custkey % 7 < 4 then 'npm' end as package_manager from customer""",
)
def detect_stack(t):
    return M.detect_stack(_facts(t))


@query(
    "client_orientation", "FN15",
    """with c as (select c_custkey as repo, c_custkey % 7 as k, c_custkey % 3 as e from customer), s as (select repo, k, e, k = 3 as broken, k = 1 or e = 1 as v, k = 1 as r from c)
    select repo, case when broken then 'not-checkable' when v and r then 'vite-react' when v then 'vite' when r then 'react' else 'none' end as kind,
    case when broken then 'not checkable' when v then 'detected' else 'not detected' end as vite, case when broken then 'not checkable' when r then 'detected' else 'not detected' end as react,
    case when broken then 'not checkable' when k = 1 then 'detected' else 'not detected' end as supabase, case when not broken and e = 1 then 'vite.config.ts' end as config, case when not broken and e = 2 then 'index.html' end as entry from s""",
)
def client_orientation(t):
    return M.client_orientation(_facts(t))


@query(
    "schedule_map", "JN7 SRC11",
    """with h as (select c_custkey as repo, '/api/cron/' || c_custkey as url, c_custkey % 2 = 0 as gated from customer where c_custkey % 3 <> 0 union all select c_custkey, '/api/other', true from customer),
    c as (select c_custkey as repo, unnest(['/api/cron/' || c_custkey, '/api/gone']) as url, unnest(['0 * * * *', '(no schedule)']) as schedule from customer where c_custkey % 4 <> 0),
    j as (select coalesce(h.repo, c.repo) as repo, coalesce(h.url, c.url) as url, schedule, gated from h full outer join c on h.repo = c.repo and h.url = c.url)
    select repo, url, schedule, gated, schedule is not null as scheduled, gated is null as missing, gated is not null and schedule is null as orphan,
    case when gated is null then 'no-handler' when not gated then 'open' else 'gated' end as tag from j where schedule is not null or starts_with(url, '/api/cron')""",
)
def schedule_map(t):
    k = F.col("c_custkey")
    cron = t.customer.where(k % 3 != 0).select(k.alias("repo"), F.concat(F.lit("/api/cron/"), k.cast("string")).alias("url"), (k % 2 == 0).alias("gated"))
    routes = cron.unionByName(t.customer.select(k.alias("repo"), F.lit("/api/other").alias("url"), F.lit(True).alias("gated")))
    text = F.concat(
        F.lit('\ufeff{"crons":[{"path":"/api/cron/'), k.cast("string"), F.lit('","schedule":"old"},{"path":"/api/gone"},{"path":"/api/cron/'), k.cast("string"),
        F.lit('","schedule":"0 * * * *"},{"schedule":"x"}]}'),
    )
    crons = S.declared_crons(t.customer.where(k % 4 != 0).select(k.alias("repo"), F.lit("vercel.json").alias("path"), text.alias("text")))
    return M.schedule_map(routes, crons)


# --- estates ----------------------------------------------------------------------------------------------------------

@query(
    "estate", "AGG15 W7",
    """with c as (select 'all' as repo, source as dir, lang, count(*) as n from documents group by source, lang), r as (select *, row_number() over (partition by dir order by n desc, lang) as rn from c)
    select repo, dir, cast(sum(n) as bigint) as files, string_agg(lang, ',' order by rn) filter (rn <= 2) as langs from r group by repo, dir""",
)
def estate(t):
    files = t.documents.select(F.lit("all").alias("repo"), F.col("source").alias("dir"), "lang")
    return M.estate(files).withColumn("langs", F.array_join("langs", ","))


_PATHS_SQL = """f as (select page_id, ['app/x.ts','.github/a.yml','README.md','vendor/x.go','lib/a.PY','app/b.unknown','docs/r.md'][page_id % 7 + 1] as path, string_split(url, '/')[3] as host from pages),
    e as (select host, case when contains(path, '/') then string_split(path, '/')[1] end as dir, case path when 'app/x.ts' then 'TypeScript' when 'lib/a.PY' then 'Python' when 'docs/r.md' then 'Markdown' when 'README.md' then 'Markdown' end as lang
      from f where path not in ('.github/a.yml', 'vendor/x.go'))"""


def _estate(t):
    names = ["app/x.ts", ".github/a.yml", "README.md", "vendor/x.go", "lib/a.PY", "app/b.unknown", "docs/r.md"]
    path = F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 7).cast("int"))
    return M.estate_files(t.pages.select(F.get(F.split("url", "/"), F.lit(2)).alias("repo"), path.alias("path")))


@query("estate_files", "AGG15", f"with {_PATHS_SQL} select dir, lang, count(*) as files from e group by all")
def estate_files(t):
    return _estate(t).groupBy("dir", "lang").agg(F.count("*").alias("files"))


@query(
    "estate_overview", "AGG15",
    f"""with {_PATHS_SQL}, l as (select host, lang, count(*) as n from e where lang is not null group by all), g as (select host, string_agg(lang || ' ' || n, ',' order by n desc, lang) as languages from l group by host)
    select e.host as repo, count(distinct dir) as folders, count(dir) as files, count(*) filter (dir is null) as loose_files, coalesce(any_value(languages), '') as languages from e left join g using (host) group by e.host""",
)
def estate_overview(t):
    """Each host's pages as files of a repo."""
    named = F.transform("languages", lambda x: F.concat_ws(" ", x["lang"], x["files"].cast("string")))
    return M.estate_overview(_estate(t)).withColumn("languages", F.array_join(named, ","))


EDGE = [
    ("const { data } = await sb.from('items').insert({ a: 1 });", "warn", "insert"),
    ("await sb.auth.getUser(); await sb.from('items').delete().eq('id', 1);", None, None),
    ("const t = req.t; await sb.from(t).update({ a: 1 });", "incomplete", None),
    ("const c = createClient(url, SERVICE_ROLE_KEY); await c.from('items').upsert({});", None, None),
    ("await sb.from('items').select('*');", None, None),
    ("// sb.from('items').insert({})\nreturn 1;", None, None),
    ("await sb.from('a').update({}); await sb.from('b').delete();", "warn", "update/delete"),
]


@query(
    "ungated_mutations", "FN16",
    r"""with f as (select doc_id, text || chr(10) || '/* ' || chr(10) || ' */ ' || ['const { data } = await sb.from(''items'').insert({ a: 1 });','await sb.auth.getUser(); await sb.from(''items'').delete().eq(''id'', 1);','const t = req.t; await sb.from(t).update({ a: 1 });',
      'const c = createClient(url, SERVICE_ROLE_KEY); await c.from(''items'').upsert({});','await sb.from(''items'').select(''*'');','// sb.from(''items'').insert({})','await sb.from(''a'').update({}); await sb.from(''b'').delete();'][doc_id % 7 + 1] as body from documents where doc_id % 5 <> 0),
    s as (select *, contains(body, '.from(t)') as computed, regexp_extract_all(body, '\.from\(''[a-z]+''\)\.(insert|update|delete)', 1) as verbs from f)
    select doc_id, case when computed then 'incomplete' else 'warn' end as status, case when not computed then array_to_string(list_distinct_in_order, '/') end as methods, cast(len(string_split(body, chr(10))) as int) as line,
      case when computed then 'edge/not-judged' else 'edge/ungated-write' end as rule_id
    from (select *, list_sort(list_distinct(verbs), 'desc') as list_distinct_in_order from s) where computed or (len(verbs) > 0 and not contains(body, 'getUser') and not contains(body, '// sb.from'))""",
)
def ungated_mutations(t):
    """Each document with a source of an edge function at its end."""
    code = F.get(F.array(*[F.lit(e[0].split("\n")[0]) for e in EDGE]), (F.col("doc_id") % 7).cast("int"))
    folder = F.when(F.col("doc_id") % 5 == 0, "src/f").otherwise("supabase/functions/f")
    files = t.documents.select(
        F.lit("r").alias("repo"), F.concat(folder, F.col("doc_id").cast("string"), F.lit("/index.ts")).alias("path"), F.concat("text", F.lit("\n/* \n */ "), code).alias("text")
    )
    return M.ungated_mutations(files).select(F.regexp_extract("path", r"/f(\d+)/", 1).cast("bigint").alias("doc_id"), "status", "methods", "line", "rule_id")


# --- file contents ------------------------------------------------------------------------------------------------------

@query(
    "bounded_content", "SRC2",
    "select doc_id, strlen(text) > 2000 as is_partial, case when strlen(text) > 2000 then sha256(encode(text)[1:500] || '\\x0A'::blob || encode(text)[strlen(text)-499:strlen(text)]) else sha256(text) end as digest from documents",
)
def bounded_content(t):
    files = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return S.bounded_content(files, "content", 2000, 500).select("doc_id", "is_partial", F.sha2("content", 256).alias("digest"))


@query(
    "decode_content", "SRC3",
    "select doc_id, case when doc_id % 5 = 3 then 'ab' || chr(0) || text else text end as text, false as is_partial, doc_id % 5 = 3 as is_binary from documents",
)
def decode_content(t):
    i = F.col("doc_id") % 5
    content = (
        F.when(i == 0, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE")))
        .when(i == 1, F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE")))
        .when(i == 3, F.concat(F.lit(b"ab\x00"), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return S.decode_content(t.documents.select("doc_id", content.alias("content"))).select("doc_id", "text", "is_partial", "is_binary")


@query(
    "json_checked", "SRC4",
    "select event_id, ['ok','broken','missing','ok'][event_id % 4 + 1] as input_state, case when event_id % 4 in (0, 3) then cast(json_extract_string(props, '$.k') as bigint) end as k from events",
)
def json_checked(t):
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.col("props")).when(i == 1, F.concat("props", F.lit("}"))).when(i == 3, F.concat(F.lit("\ufeff"), F.col("props")))
    return S.read_json_checked(t.events.select("event_id", text.alias("text")), "text", "struct<k:bigint>").select("event_id", "input_state", "json.k")


@query(
    "candidate_files", "SRC1 SET1",
    "select distinct source as repo, lang || doc_id % 100 as path from documents where doc_id % 2 = 0 or doc_id % 3 <> 0",
)
def candidate_files(t):
    files = t.documents.select(F.col("source").alias("repo"), F.concat("lang", (F.col("doc_id") % 100).cast("string")).alias("path"), "doc_id")
    tracked = files.where("doc_id % 2 = 0").select("repo", "path")
    loose = files.where("doc_id % 2 <> 0").select("repo", "path", (F.col("doc_id") % 3 == 0).alias("ignored"))
    return S.candidate_files(tracked, loose)
