"""Manifests of packages: which SDK they depend on, with names and ranges of dependencies."""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvet.functions import paths

MANIFEST = "pkg string, path string, folder string, language string, name string, sdk string, dependencies map<string,string>, error string"

#: Names of SDKs by language, in normal form.
SDKS = {
    "python": ["mcp", "fastmcp"], "javascript": ["@modelcontextprotocol/sdk", "fastmcp", "mcp-framework"], "go": ["github.com/mark3labs/mcp-go", "github.com/modelcontextprotocol/go-sdk"],
    "rust": ["rmcp", "mcp-server"], "java": ["io.modelcontextprotocol.sdk"], "csharp": ["ModelContextProtocol"], "ruby": ["mcp", "fast-mcp"], "php": ["php-mcp/server", "logiscape/mcp-sdk-php"], "swift": ["modelcontextprotocol/swift-sdk"],
}


def normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def requirement(text: str) -> tuple[str, str] | None:
    """(name, range) of a requirement line; extras are passed over, addresses have no range."""
    text = text.split("#")[0].split(";")[0].strip()
    found = re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)", text)
    if not found or text.startswith("-"):
        return None
    rest = found[2].strip().strip("()")
    return normal(found[1]), "" if rest.startswith("@") else rest


def _requirements(lines) -> dict[str, str]:
    return dict(r for r in map(requirement, lines) if r)


def _package_json(text: str) -> tuple[str | None, dict[str, str]]:
    data = json.loads(text)
    out = {}
    for group in ("optionalDependencies", "peerDependencies", "dependencies"):
        out |= {k: str(v) for k, v in (data.get(group) or {}).items()}
    return data.get("name"), out


def _pyproject(text: str) -> tuple[str | None, dict[str, str]]:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    out = _requirements(project.get("dependencies", []))
    for group in project.get("optional-dependencies", {}).values():
        out |= {k: v for k, v in _requirements(group).items() if k not in out}
    for k, v in poetry.get("dependencies", {}).items():
        if k != "python":
            out.setdefault(normal(k), v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else "")
    return project.get("name") or poetry.get("name"), out


def _setup_cfg(text: str) -> tuple[str | None, dict[str, str]]:
    c = configparser.ConfigParser(interpolation=None)
    c.read_string(text)
    return c.get("metadata", "name", fallback=None), _requirements(c.get("options", "install_requires", fallback="").splitlines())


def _setup_py(text: str) -> tuple[str | None, dict[str, str]]:
    listed = re.search(r"install_requires\s*=\s*\[(.*?)\]", text, re.S)
    name = re.search(r"\bname\s*=\s*[\"']([^\"']+)", text)
    return name and name[1], _requirements(re.findall(r"[\"']([^\"']+)[\"']", listed[1])) if listed else {}


def _metadata(text: str) -> tuple[str | None, dict[str, str]]:
    name = re.search(r"(?m)^Name:\s*(\S+)", text)
    return name and name[1], _requirements(re.findall(r"(?m)^Requires-Dist:\s*(.+)$", text))


def _mentions(language: str):
    return lambda text: (None, {s: "" for s in SDKS[language] if s in text})


READERS = [
    (r"package\.json", "javascript", _package_json), (r"pyproject\.toml", "python", _pyproject), (r"setup\.cfg", "python", _setup_cfg), (r"setup\.py", "python", _setup_py),
    (r"requirements[\w.-]*\.txt", "python", lambda t: (None, _requirements(t.splitlines()))), (r"METADATA|PKG-INFO", "python", _metadata), (r"go\.mod", "go", _mentions("go")),
    (r"Cargo\.toml", "rust", lambda t: (tomllib.loads(t).get("package", {}).get("name"), {k: "" for k in tomllib.loads(t).get("dependencies", {})})), (r"pom\.xml|build\.gradle(?:\.kts)?", "java", _mentions("java")),
    (r".*\.csproj", "csharp", _mentions("csharp")), (r"Gemfile", "ruby", lambda t: (None, {n: "" for n in re.findall(r"(?m)^\s*gem\s+[\"']([^\"']+)", t)})), (r"composer\.json", "php", lambda t: (json.loads(t).get("name"), {k: str(v) for k, v in (json.loads(t).get("require") or {}).items()})),
    (r"Package\.swift", "swift", _mentions("swift")),
]


def manifest_of(path: str, content: bytes) -> tuple | None:
    """(folder, language, name, sdk, dependencies, error) of a manifest; None for other files."""
    folder, _, file = path.rpartition("/")
    for pattern, language, reader in READERS:
        if re.fullmatch(pattern, file):
            try:
                name, dependencies = reader(content.decode("utf-8", "replace"))
            except (ValueError, AttributeError, TypeError, configparser.Error) as e:
                return folder or ".", language, None, None, {}, type(e).__name__
            return folder or ".", language, name, next((s for s in SDKS[language] if s in dependencies), None), dependencies, None
    return None


def read(files: DataFrame) -> DataFrame:
    """MANIFEST rows of files (pkg, path, content); a file without content gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(pkg, path, *m) for pkg, path, content in zip(pdf["pkg"], pdf["path"], pdf["content"], strict=True) if (m := manifest_of(path, bytes(content)))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    return files.where("content IS NOT NULL").select("pkg", "path", "content").mapInPandas(run, MANIFEST)


def importing_folders(facts: DataFrame) -> DataFrame:
    """pkg, folder, language: where the first file, by path, imports an SDK; files of tests don't count. facts: pkg, path, fact, name."""
    python = F.col("path").endswith(".py")
    names = {language: "|".join(re.escape(s) for s in SDKS[language]) for language in ("python", "javascript")}
    known = F.when(python, F.col("name").rlike(rf"^(?:{names['python']})(?:\.|\z)")).otherwise(F.col("name").rlike(rf"^(?:{names['javascript']})(?:/|\z)"))
    found = facts.where("fact = 'import'").where(known & (paths.location_kind(F.col("path")) != "test_or_example"))
    first = found.groupBy("pkg").agg(F.min("path").alias("path"))
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1), F.lit("")), F.lit("."))
    return first.select("pkg", folder.alias("folder"), F.when(F.col("path").endswith(".py"), "python").otherwise("javascript").alias("language"))


def detect(files: DataFrame, manifests: DataFrame, imports: DataFrame | None = None, most: int = 50) -> DataFrame:
    """pkg, status (ok, compiled, multiple_servers, unsupported_language, no_tools_found, not_a_server), folder, language, candidates, truncated, partly_compiled.

    Candidates are folders whose manifest names an SDK; test folders are dropped when others remain. Without any, the folder of `imports` (see
    importing_folders) counts. JavaScript with a TypeScript file or settings in its folder is typescript. A server of binaries without source is compiled.
    """
    c = manifests.where("sdk IS NOT NULL").withColumn("test", paths.in_test_folder(F.concat("folder", F.lit("/x"))))
    first = Window.partitionBy("pkg", "folder").orderBy("path")
    c = c.withColumn("k", F.row_number().over(first)).where("k = 1")
    c = c.withColumn("others", F.bool_or(~F.col("test")).over(Window.partitionBy("pkg"))).where("NOT (test AND others)")
    n = c.groupBy("pkg").agg(F.count("*").alias("candidates"), F.min_by("folder", "folder").alias("folder"), F.min_by("language", "folder").alias("language"))
    if imports is not None:
        n = n.unionByName(imports.join(n.select("pkg"), "pkg", "left_anti").withColumn("candidates", F.lit(1).cast("long")))
    kept = files.where(~paths.is_ignored(F.col("path"))).join(n.where("candidates = 1").select("pkg", "folder"), "pkg", "left")
    here = paths.inside(F.col("path"), F.col("folder"))
    source = F.col("path").rlike(r"\.(?:py|[cm]?[jt]sx?)\z") & ~F.col("path").rlike(r"\.d\.[cm]?ts\z")
    typed = F.col("path").rlike(r"(?:^|/)tsconfig(?:\.[^/]*)?\.json\z|\.[cm]?tsx?\z") & ~F.col("path").rlike(r"\.d\.[cm]?ts\z")
    binary = F.coalesce(paths.binary_signature(F.col("content")).isNotNull(), F.lit(False))
    code = kept.groupBy("pkg").agg(F.bool_or(source).alias("code"), F.bool_or(here & typed).alias("typed"), F.bool_or(here & binary).alias("binary"), F.bool_or(here & source).alias("readable"))
    out = files.select("pkg").distinct().join(code, "pkg", "left").join(n, "pkg", "left")  # a package of ignored files alone has a row too
    read = F.col("language").isin("python", "javascript")
    status = (
        F.when(F.col("candidates") > 1, "multiple_servers")
        .when((F.col("candidates") == 1) & read & F.col("binary") & ~F.col("readable"), "compiled")
        .when((F.col("candidates") == 1) & read, "ok")
        .when(F.col("candidates") == 1, "unsupported_language")
        .when(F.col("code"), "no_tools_found")
        .otherwise("not_a_server")
    )
    one = F.col("candidates") == 1
    language = F.when((F.col("language") == "javascript") & F.col("typed"), "typescript").otherwise(F.col("language"))
    return out.select(
        "pkg", status.alias("status"), F.when(one, F.col("folder")).alias("folder"), F.when(one, language).alias("language"), F.least(F.coalesce("candidates", F.lit(0)), F.lit(most)).alias("candidates"),
        F.coalesce(F.col("candidates") > most, F.lit(False)).alias("truncated"), F.coalesce(one & read & F.col("binary") & F.col("readable"), F.lit(False)).alias("partly_compiled"),
    )
