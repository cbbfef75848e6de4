"""Readers on small files of each format."""

import json

import pytest

from loomgraph.sources import coverage_reports as C
from loomgraph.sources import manifests as M
from loomgraph.sources import trees as T


def deps(path, text, kind="dependency"):
    return {(r[3], r[4]) for r in M.parse(path, text) if r[2] == kind}


CASES = [
    ("requirements.txt", "Foo_Bar>=1.0  # c\n-r other.txt\nbaz[x]==2 ; python_version<'3'\n", "dependency", {("foo-bar", ">=1.0"), ("baz", "==2")}),
    ("a/pyproject.toml", '[project]\ndependencies=["x>1"]\n[project.scripts]\nrun="a:b"\n[tool.poetry.dependencies]\npython="^3"\ny={version="2"}\n', "dependency", {("x", ">1"), ("y", "2")}),
    ("setup.cfg", "[options]\ninstall_requires =\n    a>=1\n    b\n", "dependency", {("a", ">=1"), ("b", None)}),
    ("package.json", '{"dependencies":{"a":"^1"},"devDependencies":{"b":"2"},"scripts":{"t":"x"}}', "dependency", {("a", "^1"), ("b", "2")}),
    ("deno.jsonc", '{// c\n"imports":{"a":"http://x//y",},}', "dependency", {("a", "http://x//y")}),
    ("Cargo.toml", '[dependencies]\na="1"\nb={version="2",package="c"}\n', "dependency", {("a", "1"), ("c", "2")}),
    ("go.mod", "module m\nrequire (\n a/b v1.0.0\n c/d v2 // indirect\n)\nrequire e/f v3\n", "dependency", {("a/b", "v1.0.0"), ("c/d", "v2"), ("e/f", "v3")}),
    ("pom.xml", "<project xmlns='u'><properties><v>9</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>", "dependency", {("g:a", "9")}),
    ("build.gradle", "dependencies { implementation 'g:a:1'\n testImplementation(\"h:b:2\") }", "dependency", {("g:a", "1"), ("h:b", "2")}),
    ("x.csproj", '<Project><ItemGroup><PackageReference Include="A" Version="1"/></ItemGroup></Project>', "dependency", {("A", "1")}),
    ("composer.json", '{"require":{"php":"8","a/b":"^1"}}', "dependency", {("a/b", "^1")}),
    ("Gemfile", "gem 'a', '~> 1'\ngem \"b\"\n", "dependency", {("a", "~> 1"), ("b", None)}),
    ("pubspec.yaml", "dependencies:\n  a: ^1\n  b:\n    sdk: x\n", "dependency", {("a", "^1"), ("b", None)}),
    ("environment.yml", "dependencies:\n  - numpy=1.2\n  - scipy\n", "dependency", {("numpy", "=1.2"), ("scipy", None)}),
    ("docker-compose.yml", "services:\n  web:\n    image: a:1\n    depends_on:\n      - db\n  db:\n    image: pg\n", "image", {("a:1", None), ("pg", None)}),
    ("docker-compose.yml", "services:\n  web:\n    depends_on:\n      - db\n  db:\n    image: pg\n", "dependency", {("db", None)}),
    ("Dockerfile", 'FROM a:1 AS b\nENV X=1 \\\n  Y=2\nFROM b\nCMD ["x", "y"]\n', "image", {("a:1", None)}),
    ("Dockerfile", 'FROM a\nENV X=1 \\\n  Y=2\n', "env", {("X", "1"), ("Y", "2")}),
    ("Procfile", "web: run me\n", "entry", {("web", "run me")}),
    (".github/workflows/a.yml", "jobs:\n  b:\n    steps:\n      - uses: x/y@v1\n      - run: make\n", "dependency", {("x/y", "v1")}),
    (".env", "export A='1'\n# c\nB=\n", "env", {("A", "1"), ("B", None)}),
    (".gitmodules", '[submodule "a"]\n\tpath = a\n\turl = u\n', "module", {("a", "u")}),
    ("package-lock.json", '{"packages":{"":{},"node_modules/a":{"version":"1"},"node_modules/a/node_modules/@s/b":{"version":"2"}}}', "locked", {("a", "1"), ("@s/b", "2")}),
    ("yarn.lock", '"@s/a@^1", "@s/a@^2":\n  version "1.5"\nb@1:\n  version "3"\n', "locked", {("@s/a", "1.5"), ("b", "3")}),
    ("pnpm-lock.yaml", "packages:\n  /a@1.0:\n    x: y\n  '@s/b@2.0':\n    x: y\n", "locked", {("a", "1.0"), ("@s/b", "2.0")}),
    ("poetry.lock", '[[package]]\nname="a"\nversion="1"\n', "locked", {("a", "1")}),
    ("go.sum", "a/b v1 h1:x=\na/b v1/go.mod h1:y=\n", "locked", {("a/b", "v1")}),
    ("Gemfile.lock", "GEM\n  specs:\n    a (1.0)\n      b (>= 2)\n", "locked", {("a", "1.0")}),
]


@pytest.mark.parametrize("path,text,kind,want", CASES, ids=[f"{c[0]}:{c[2]}" for c in CASES])
def test_manifest(path, text, kind, want):
    assert deps(path, text, kind) == want


def test_read_manifests(spark):
    files = spark.createDataFrame([("a/package.json", "{bad"), ("b/Procfile", "w: x"), ("c.py", "x"), ("d/package.json", None)], "path string, text string")
    got = {(r.path, r.kind, r.name) for r in M.read_manifests(files).collect()}
    assert got == {("a/package.json", "error", "JSONDecodeError"), ("b/Procfile", "entry", "w")}


REPORTS = {
    "cobertura": '<?xml version="1.0"?><coverage><packages><package name="p"><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>',
    "jacoco": '<?xml version="1.0"?><report name="r"><package name="p"><sourcefile name="A.java"><line nr="1" ci="2"/><line nr="2" ci="0"/></sourcefile></package></report>',
    "lcov": "TN:\nSF:a.js\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.js\nDA:7,1\nend_of_record\n",
    "istanbul": json.dumps({"a.js": {"path": "a.js", "statementMap": {"0": {"start": {"line": 1}}, "1": {"start": {"line": 2}}}, "s": {"0": 3, "1": 0}}}),
    "go": "mode: set\nm/a.go:1.2,2.3 1 1\nm/a.go:4.1,4.9 1 0\n",
}
WANT = {
    "cobertura": {("a.py", 1, True), ("a.py", 2, False)},
    "jacoco": {("p/A.java", 1, True), ("p/A.java", 2, False)},
    "lcov": {("a.js", 1, True), ("a.js", 2, False), ("b.js", 7, True)},
    "istanbul": {("a.js", 1, True), ("a.js", 2, False)},
    "go": {("m/a.go", 1, True), ("m/a.go", 2, True), ("m/a.go", 4, False)},
}


def test_coverage_reports(spark):
    rows = C.read_reports(spark.createDataFrame(list(REPORTS.items()), "report string, text string")).collect()
    got = {name: {(r.path, r.line, r.hit) for r in rows if r.report == name} for name in REPORTS}
    assert got == WANT


def test_ranges(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 9, 10)], "path string, line int")
    assert C.compact_ranges(df, ["path"]).first().ranges == "1-3, 7, 9-10"


def test_trees(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name, data in {"a/b/x.txt": b"hi\n", "y.bin": b"\x00\x01", ".git/z": b"z"}.items():
        (tmp_path / name).write_bytes(data)
    tree = T.directory(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"a/b/x.txt", "y.bin"}
    assert {r.path: r.t for r in tree.select("path", T.text_of(tree.content).alias("t")).collect()} == {"a/b/x.txt": "hi\n", "y.bin": None}
    assert {r.directory for r in T.directories(tree).collect()} == {"a", "a/b"}
    over = T.overlay(tree, spark.createDataFrame([("y.bin", None), ("n", bytearray(b"n"))], T.SCHEMA))
    assert {r.path for r in over.collect()} == {"a/b/x.txt", "n"}
    assert {r.path for r in T.changed_paths(T.blobs(tree), T.blobs(over)).collect()} == {"y.bin", "n"}
    assert {r.blob for r in T.blobs(tree).where("path = 'a/b/x.txt'").collect()} == {"45b983be36b73c0788dc9cbcb76cbb80fc7bb057"}
    assert {r.directory for r in T.topmost(T.directories(tree)).collect()} == {"a"}
    assert {r.path for r in T.nested(tree, over, "a").collect()} == {"y.bin", "a/a/b/x.txt", "a/n"}
    assert T.empty(spark).count() == 0
