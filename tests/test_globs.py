"""Tables of globs against trying every glob on every path."""

import random
import re

from wardline.functions.paths import glob_literal
from wardline.operators.globs import first_globs, glob_key, match_globs, plain_glob

SEGMENTS = ["src", "a", "lib", "x.ts", "y.md", "", ".env", "a.b.ts", "read me", "été", "{x}", "a(b)"]


def test_random_globs(spark):
    rng = random.Random(3)
    part = lambda: rng.choice([*SEGMENTS, "*", "**", "?", "*.ts", "a*", "*.b.*", "?.md", "**x", "a**", "*.*"])
    globs = ["/".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/", "/**"]) for _ in range(500)]
    globs = list({*globs, "", "/**", "**", "/", "./src/a", "src\\a\\*", "**/", "*"})
    paths = list({"/".join(rng.choice(SEGMENTS) for _ in range(rng.randint(1, 4))) for _ in range(200)}) + ["", "line\nbreak/x.ts", "./src/a", "src\\a\\x.ts", "ab", "lib/ab"]
    rules = [("r", g, i) for i, g in enumerate(globs)] + [("s", "**/*.ts", 0), ("s", None, 1), (None, "**", 2)]
    hits = [("r", p) for p in paths] * 2 + [("s", "a/x.ts"), ("s", None), (None, "a"), ("t", "a")]
    got = match_globs(spark.createDataFrame(hits, "repo string, path string"), spark.createDataFrame(rules, "repo string, glob string, pos int"), ["repo"]).collect()
    slashed = lambda p: re.sub(r"^\./", "", p.replace("\\", "/"))
    tried = {g: re.compile(glob_literal(g, end=r"\Z")) for g in globs}
    want = {("r", p, g) for g in globs for p in paths if tried[g].search(slashed(p))} | {("s", "a/x.ts", "**/*.ts")}
    assert len(got) == len({(r.repo, r.path, r.glob) for r in got})
    assert {(r.repo, r.path, r.glob) for r in got} == want
    assert len(want) > 1000


def test_the_first_glob_of_a_list(spark):
    globs = spark.createDataFrame([("r", "src/**", 2), ("r", "src/*.ts", 1), ("r", "**/b.ts", 0), ("q", "**", 0)], "repo string, glob string, pos int")
    paths = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/b.ts"), ("r", "src/x/c.md"), ("r", "z")], "repo string, path string")
    assert {tuple(r) for r in first_globs(paths, globs, ["repo"]).collect()} == {("r", "src/a.ts", "src/*.ts"), ("r", "src/b.ts", "**/b.ts"), ("r", "src/x/c.md", "src/**")}


def test_globs_are_looked_up_by_all_that_they_fix(spark):
    shapes = {"src1/*/77.ts": "under tail5", "**/*77.x3": "any tail5", "src?/en/77*": "any head2", "**/f?/*77*": "any mid2", "src1/a*.b": "under tail2", "**/x**": "any", "src/**/*": "under"}
    df = spark.createDataFrame([(g,) for g in shapes], "glob string")
    assert {r.glob: r.kind for r in df.select("glob", glob_key(plain_glob(df.glob))["kind"].alias("kind")).collect()} == shapes
