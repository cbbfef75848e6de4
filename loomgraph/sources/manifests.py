"""Manifests and lock files as rows (path, ecosystem, kind, name, spec, scope).

``kind`` is dependency, entry (a command or script), locked (an exact version),
image, service, env or module. Each file is parsed by itself in Arrow batches;
a file that doesn't parse gives one row of kind error, never a failed job.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

Row = tuple[str, str, "str | None", str]
SCHEMA = "path string, ecosystem string, kind string, name string, spec string, scope string"
PEP508 = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*(@\s*[^;]+|\(?[^;#]*?\)?)?\s*(;.*)?$")


def python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def pep508(line: str, scope: str = "runtime") -> list[Row]:
    m = PEP508.match(line)
    return [("dependency", python_name(m[1]), (m[3] or "").strip(" ()") or None, scope)] if m else []


def requirements(text: str) -> list[Row]:
    out = []
    for raw in re.sub(r"\\\n", " ", text).splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).strip()
        line = re.sub(r"\s--hash[= ]\S+", "", line)
        egg = re.search(r"[#&]egg=([A-Za-z0-9._-]+)", raw)
        if egg:
            out.append(("dependency", python_name(egg[1]), None, "runtime"))
        elif line and not line.startswith("-"):
            out += pep508(line)
    return out


def _spec(v: object) -> str | None:
    if isinstance(v, dict):
        return str(v["version"]) if "version" in v else None
    return None if v is None else str(v)


def pyproject(text: str) -> list[Row]:
    doc = tomllib.loads(text)
    project, out = doc.get("project", {}), []
    for line in project.get("dependencies", []):
        out += pep508(line)
    for extra, rows in project.get("optional-dependencies", {}).items():
        out += [r for line in rows for r in pep508(line, f"optional:{extra}")]
    for group, rows in doc.get("dependency-groups", {}).items():
        out += [r for line in rows if isinstance(line, str) for r in pep508(line, f"group:{group}")]
    for line in doc.get("build-system", {}).get("requires", []):
        out += pep508(line, "build")
    poetry = doc.get("tool", {}).get("poetry", {})
    tables = {"runtime": poetry.get("dependencies", {}), "dev": poetry.get("dev-dependencies", {})}
    tables |= {f"group:{g}": t.get("dependencies", {}) for g, t in poetry.get("group", {}).items()}
    out += [("dependency", python_name(n), _spec(v), s) for s, t in tables.items() for n, v in t.items() if n != "python"]
    for table in ("scripts", "gui-scripts"):
        out += [("entry", n, str(v), table) for n, v in (project.get(table, {}) | poetry.get(table, {})).items()]
    return out


def setup_cfg(text: str) -> list[Row]:
    cfg = configparser.RawConfigParser(strict=False)
    cfg.read_string(text)
    get = lambda s, k: cfg.get(s, k, fallback="").splitlines()
    out = [r for line in get("options", "install_requires") if line.strip() for r in pep508(line)]
    if cfg.has_section("options.extras_require"):
        out += [r for k in cfg.options("options.extras_require") for line in get("options.extras_require", k) if line.strip() for r in pep508(line, f"optional:{k}")]
    for line in get("options.entry_points", "console_scripts"):
        if "=" in line:
            out.append(("entry", line.split("=", 1)[0].strip(), line.split("=", 1)[1].strip(), "scripts"))
    return out


def pipfile(text: str) -> list[Row]:
    doc = tomllib.loads(text)
    return [("dependency", python_name(n), _spec(v), s) for t, s in (("packages", "runtime"), ("dev-packages", "dev")) for n, v in doc.get(t, {}).items()]


def jsonc(text: str) -> object:
    """JSON with comments and trailing commas; both are left alone inside strings."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def package_json(text: str) -> list[Row]:
    doc = json.loads(text)
    tables = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
    out = [("dependency", n, _spec(v), s) for t, s in tables.items() for n, v in (doc.get(t) or {}).items()]
    out += [("entry", n, str(v), "scripts") for n, v in (doc.get("scripts") or {}).items()]
    binary = doc.get("bin") or {}
    out += [("entry", n, v, "bin") for n, v in (binary if isinstance(binary, dict) else {doc.get("name", ""): binary}).items()]
    spaces = doc.get("workspaces") or []
    return out + [("module", w, None, "workspace") for w in (spaces.get("packages", []) if isinstance(spaces, dict) else spaces)]


def deno(text: str) -> list[Row]:
    doc = jsonc(text)
    out = [("dependency", n, str(v), "runtime") for n, v in (doc.get("imports") or {}).items()]
    return out + [("entry", n, str(v), "tasks") for n, v in (doc.get("tasks") or {}).items()]


def cargo(text: str) -> list[Row]:
    doc = tomllib.loads(text)
    tables = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}
    holders = [doc, doc.get("workspace", {}), *doc.get("target", {}).values()]
    out = [("dependency", v.get("package", n) if isinstance(v, dict) else n, _spec(v), s) for h in holders for t, s in tables.items() for n, v in h.get(t, {}).items()]
    out += [("entry", b.get("name", ""), b.get("path"), "bin") for b in doc.get("bin", [])]
    return out + [("module", m, None, "workspace") for m in doc.get("workspace", {}).get("members", [])]


def go_mod(text: str) -> list[Row]:
    out, block = [], None
    for raw in text.splitlines():
        line, _, note = raw.partition("//")
        line = line.strip()
        if opened := re.match(r"^(\w+)\s*\($", line):
            block = opened[1]
            continue
        if line == ")":
            block = None
            continue
        word, rest = (block, line) if block else (line.split(" ", 1) + [""])[:2]
        parts = rest.split()
        if word == "require" and len(parts) >= 2:
            out.append(("dependency", parts[0], parts[1], "indirect" if "indirect" in note else "runtime"))
        elif word == "use" and parts:
            out.append(("module", parts[0], None, "workspace"))
        elif word == "module" and parts:
            out.append(("module", parts[0], None, "self"))
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def pom(text: str) -> list[Row]:
    root = ElementTree.fromstring(text)
    props = {_local(p.tag): (p.text or "").strip() for e in root.iter() if _local(e.tag) == "properties" for p in e}
    out = []
    for e in root.iter():
        if _local(e.tag) == "dependency":
            f = {_local(c.tag): (c.text or "").strip() for c in e}
            version = re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1], m[0]), f.get("version", ""))
            out.append(("dependency", f"{f.get('groupId', '')}:{f.get('artifactId', '')}", version or None, f.get("scope", "compile")))
        elif _local(e.tag) == "module":
            out.append(("module", (e.text or "").strip(), None, "child"))
    return out


def gradle(text: str) -> list[Row]:
    scopes = r"(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor|kapt|classpath)"
    out = [("dependency", f"{m[2]}:{m[3]}", m[4], m[1]) for m in re.finditer(scopes + r"""\s*\(?\s*['"]([^:'"\s]+):([^:'"]+)(?::([^:'"]+))?[^'"]*['"]""", text)]
    out += [("module", m[2].lstrip(":").replace(":", "/"), None, m[1]) for m in re.finditer(scopes + r"""\s*\(?\s*project\(\s*['"]([^'"]+)['"]""", text)]
    for m in re.finditer(r"(?m)^\s*include\s*\(?([^\n)]*)", text):
        out += [("module", p.lstrip(":").replace(":", "/"), None, "child") for p in re.findall(r"['\"]([^'\"]+)['\"]", m[1])]
    return out


def msbuild(text: str) -> list[Row]:
    out = []
    for e in ElementTree.fromstring(text).iter():
        kids = {_local(c.tag): c.text for c in e}
        if _local(e.tag) in ("PackageReference", "PackageVersion") and (name := e.get("Include") or e.get("Update")):
            out.append(("dependency", name, e.get("Version") or kids.get("Version"), "runtime"))
        elif _local(e.tag) == "ProjectReference" and e.get("Include"):
            out.append(("module", e.get("Include").replace("\\", "/"), None, "project"))
    return out


def solution(text: str) -> list[Row]:
    return [("module", m[1].replace("\\", "/"), None, "project") for m in re.finditer(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.\w*proj)"', text)]


def composer(text: str) -> list[Row]:
    doc = json.loads(text)
    return [("dependency", n, _spec(v), s) for t, s in (("require", "runtime"), ("require-dev", "dev")) for n, v in (doc.get(t) or {}).items() if n != "php" and not n.startswith("ext-")]


def gemfile(text: str) -> list[Row]:
    out = []
    for m in re.finditer(r"""(?m)^\s*(?:gem|\w+\.add_(runtime_|development_)?dependency)[\s(]+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", text):
        out.append(("dependency", m[2], m[3], "dev" if m[1] == "development_" else "runtime"))
    return out


def indented(text: str) -> list[tuple[int, str, str]]:
    """(indent, key, value) of a YAML file's mapping lines; ``- `` items have the key '-'. Enough for manifests."""
    out = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        body = line.lstrip()
        if not body or body in ("---", "..."):
            continue
        depth = len(line) - len(body)
        while body.startswith("- ") or body == "-":
            out.append((depth, "-", body[2:].strip().strip("'\"")))
            depth += len(body) - len(body[1:].lstrip()) if len(body) > 1 else 2
            body = body[1:].lstrip()
        if m := re.match(r"""^(['"]?)([^'"#:]+|[^'"]+)\1:(?:\s+(.*))?$""", body):
            out.append((depth, m[2].strip(), (m[3] or "").strip().strip("'\"")))
    return out


def _under(rows: list[tuple[int, str, str]], key: str) -> list[tuple[int, str, str]]:
    """The lines below top-level ``key``."""
    out, on = [], False
    for d, k, v in rows:
        if d == 0 and k != "-":
            on = k == key
        elif on:
            out.append((d, k, v))
    return out


def pubspec(text: str) -> list[Row]:
    rows, out = indented(text), []
    for t, s in (("dependencies", "runtime"), ("dev_dependencies", "dev")):
        below = _under(rows, t)
        level = min((d for d, _, _ in below), default=0)
        out += [("dependency", k, v or None, s) for d, k, v in below if d == level]
    return out


def conda(text: str) -> list[Row]:
    out = []
    for _, k, v in _under(indented(text), "dependencies"):
        if k == "-" and (m := re.match(r"^([A-Za-z0-9._-]+)\s*([=<>!~].*)?$", v)):
            out.append(("dependency", m[1].lower(), m[2], "runtime"))
    return out


def compose(text: str) -> list[Row]:
    below = _under(indented(text), "services")
    level, out, service, part = min((d for d, _, _ in below), default=0), [], "", ""
    for d, k, v in below:
        if d == level and k != "-":
            service, part = k, ""
            out.append(("service", k, None, "service"))
        elif k == "image":
            out.append(("image", re.sub(r"\$\{\w+:?-([^}]*)\}", r"\1", v), None, service))
        elif k in ("depends_on", "environment", "links", "volumes"):
            part = k
            out += [("dependency", x.strip(" '\""), None, service) for x in v.strip("[]").split(",") if x.strip() and k in ("depends_on", "links")]
        elif part in ("depends_on", "links") and (k == "-" or (v == "" and k != "-")):
            out.append(("dependency", (v or k).split(":")[0], None, service))
        elif part == "environment":
            name, _, value = v.partition("=") if k == "-" else (k, "", v)
            out.append(("env", name, value or None, service))
    return out


def dockerfile(text: str) -> list[Row]:
    out, stages = [], set()
    for line in re.sub(r"\\[ \t]*\n", " ", re.sub(r"(?m)^\s*#.*\n?", "", text)).splitlines():
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if word.upper() == "FROM" and (m := re.match(r"^(?:--\S+\s+)*(\S+)(?:\s+[Aa][Ss]\s+(\S+))?", rest)):
            if m[1].lower() not in stages:
                out.append(("image", m[1], None, "base"))
            stages.add((m[2] or "").lower())
        elif word.upper() in ("CMD", "ENTRYPOINT"):
            command = " ".join(json.loads(rest)) if rest.startswith("[") else rest
            out.append(("entry", word.lower(), command, "container"))
        elif word.upper() == "ENV":
            pairs = re.findall(r'(\w+)=("[^"]*"|\S*)', rest) or [tuple((rest.split(None, 1) + [""])[:2])]
            out += [("env", n, v.strip('"') or None, "container") for n, v in pairs]
        elif word.upper() == "EXPOSE":
            out += [("entry", p, None, "port") for p in rest.split()]
    return out


def procfile(text: str) -> list[Row]:
    return [("entry", m[1], m[2], "process") for m in re.finditer(r"(?m)^([\w-]+):\s*(.+)$", text)]


def workflow(text: str) -> list[Row]:
    out = [("entry", v, None, "run") for _, k, v in indented(text) if k == "run" and v not in ("", "|", ">")]
    return out + [("dependency", v.split("@")[0], v.split("@")[1] if "@" in v else None, "action") for _, k, v in indented(text) if k == "uses"]


def env_file(text: str) -> list[Row]:
    return [("env", m[1], m[2].strip().strip("'\"") or None, "file") for m in re.finditer(r"(?m)^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=(.*)$", text)]


def gitmodules(text: str) -> list[Row]:
    cfg = configparser.RawConfigParser(strict=False)
    cfg.read_string("\n".join(line.strip() for line in text.splitlines()))
    return [("module", cfg.get(s, "path", fallback=""), cfg.get(s, "url", fallback=None), "submodule") for s in cfg.sections()]


def npm_lock(text: str) -> list[Row]:
    doc, out = json.loads(text), []
    for key, v in (doc.get("packages") or {}).items():
        if key and "version" in v:
            out.append(("locked", v.get("name") or key.rsplit("node_modules/", 1)[-1], v["version"], "dev" if v.get("dev") else "runtime"))

    def walk(deps: dict) -> Iterator[Row]:
        for n, v in deps.items():
            yield ("locked", n, v.get("version"), "dev" if v.get("dev") else "runtime")
            yield from walk(v.get("dependencies") or {})

    return out or list(walk(doc.get("dependencies") or {}))


def yarn_lock(text: str) -> list[Row]:
    return [("locked", m[1], m[2], "runtime") for m in re.finditer(r'(?m)^"?(@?[^@"\s]+)@[^\n]*:\n\s+version:?\s+"?([^"\s]+)"?', text)]


def pnpm_lock(text: str) -> list[Row]:
    out = [re.match(r"^/?(@?[^@/]+(?:/[^@/]+)?)[@/](\d[^()]*)", k) for d, k, _ in _under(indented(text), "packages") if k != "-"]
    return [("locked", m[1], m[2], "runtime") for m in out if m]


def toml_lock(text: str) -> list[Row]:
    return [("locked", p.get("name", ""), p.get("version"), "runtime") for p in tomllib.loads(text).get("package", [])]


def pipfile_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    return [("locked", python_name(n), (v.get("version") or "").lstrip("=") or None, s) for t, s in (("default", "runtime"), ("develop", "dev")) for n, v in doc.get(t, {}).items()]


def composer_lock(text: str) -> list[Row]:
    doc = json.loads(text)
    return [("locked", p["name"], p.get("version"), s) for t, s in (("packages", "runtime"), ("packages-dev", "dev")) for p in doc.get(t) or []]


def go_sum(text: str) -> list[Row]:
    found = {(m[1], m[2]) for m in re.finditer(r"(?m)^(\S+) (v\S+?)(?:/go\.mod)? h1:", text)}
    return [("locked", n, v, "runtime") for n, v in sorted(found)]


def gem_lock(text: str) -> list[Row]:
    return [("locked", m[1], m[2], "runtime") for m in re.finditer(r"(?m)^ {4}([\w.-]+) \(([^)]+)\)$", text)]


#: File name pattern, ecosystem, reader; the first that fits reads the file.
READERS: list[tuple[str, str, Callable[[str], list[Row]]]] = [
    (r"(^|/)pyproject\.toml$", "python", pyproject),
    (r"(^|/)setup\.cfg$", "python", setup_cfg),
    (r"(^|/)[\w.-]*requirements[\w.-]*\.(txt|in)$", "python", requirements),
    (r"(^|/)requirements/[^/]+\.(txt|in)$", "python", requirements),
    (r"(^|/)Pipfile$", "python", pipfile),
    (r"(^|/)environment\.ya?ml$", "conda", conda),
    (r"(^|/)package\.json$", "npm", package_json),
    (r"(^|/)deno\.jsonc?$", "deno", deno),
    (r"(^|/)Cargo\.toml$", "cargo", cargo),
    (r"(^|/)go\.(mod|work)$", "go", go_mod),
    (r"(^|/)pom\.xml$", "maven", pom),
    (r"\.gradle(\.kts)?$", "gradle", gradle),
    (r"\.(cs|fs|vb)proj$|(^|/)Directory\.(Packages|Build)\.props$", "nuget", msbuild),
    (r"\.sln$", "nuget", solution),
    (r"(^|/)composer\.json$", "composer", composer),
    (r"(^|/)Gemfile$|\.gemspec$", "gem", gemfile),
    (r"(^|/)pubspec\.ya?ml$", "pub", pubspec),
    (r"(^|/)(docker-)?compose[\w.-]*\.ya?ml$", "compose", compose),
    (r"(^|/)([\w.-]+\.)?Dockerfile(\.[\w.-]+)?$", "docker", dockerfile),
    (r"(^|/)Procfile$", "process", procfile),
    (r"(^|/)\.github/workflows/[^/]+\.ya?ml$", "workflow", workflow),
    (r"(^|/)\.env(\.[\w-]+)?$", "env", env_file),
    (r"(^|/)\.gitmodules$", "submodule", gitmodules),
    (r"(^|/)(package-lock|npm-shrinkwrap)\.json$", "npm", npm_lock),
    (r"(^|/)yarn\.lock$", "npm", yarn_lock),
    (r"(^|/)pnpm-lock\.yaml$", "npm", pnpm_lock),
    (r"(^|/)(poetry|uv|pdm)\.lock$", "python", toml_lock),
    (r"(^|/)Cargo\.lock$", "cargo", toml_lock),
    (r"(^|/)Pipfile\.lock$", "python", pipfile_lock),
    (r"(^|/)composer\.lock$", "composer", composer_lock),
    (r"(^|/)go\.sum$", "go", go_sum),
    (r"(^|/)Gemfile\.lock$", "gem", gem_lock),
]


def parse(path: str, text: str) -> list[tuple[str, str, str, str, str | None, str]]:
    for pattern, ecosystem, reader in READERS:
        if re.search(pattern, path):
            try:
                return [(path, ecosystem, *row) for row in reader(text)]
            except Exception as e:  # a bad file is a diagnostic, not a failure of the job
                return [(path, ecosystem, "error", type(e).__name__, str(e)[:200], "")]
    return []


def read_manifests(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for the manifests among ``files (path, text)``; other files are dropped before Python sees them."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t in zip(f["path"], f["text"]) for r in parse(p, t)]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "kind", "name", "spec", "scope"], dtype=object)

    wanted = "|".join(f"(?:{p})" for p, _, _ in READERS)
    return files.where(files.path.rlike(wanted) & files.text.isNotNull()).select("path", "text").mapInPandas(batches, SCHEMA)
