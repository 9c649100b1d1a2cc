"""Requests as text: a repository address, an npx command or a uvx command; each becomes a kind with parts, or an error code."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "version", "owner", "repo", "ref_path", "error_code")])
#: Fixed value: characters of a request.
LONGEST = 2048
NPM = r"(?:@[a-z0-9~][a-z0-9._~-]*/)?[a-z0-9~][a-z0-9._~-]*"
PYPI = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"


def parse(text: str | None) -> dict[str, str | None]:
    out: dict[str, str | None] = dict.fromkeys(PARSED.names)
    text = (text or "").strip(" \t\r\n")

    def failed(code: str) -> dict[str, str | None]:
        return out | {"error_code": code}

    if not text:
        return failed("empty")
    if len(text) > LONGEST:
        return failed("too_long")
    if any(unicodedata.category(c) in ("Cc", "Cf") for c in text):
        return failed("control_character")
    words = text.split()
    if words[0] == "npx":
        rest = [w for w in words[1:] if w not in ("-y", "--yes")]
        if "-p" in rest or "--package" in rest:
            rest = rest[(rest.index("-p") if "-p" in rest else rest.index("--package")) + 1 :]
        found = re.fullmatch(rf"({NPM})(?:@([\w.^~<>=*+-]+))?", rest[0]) if rest else None
        return out | {"kind": "npm", "name": found[1], "version": found[2]} if found else failed("bad_npx")
    if words[0] == "uvx":
        rest = words[1:]
        if "--from" in rest:
            rest = rest[rest.index("--from") + 1 :]
        found = re.fullmatch(rf"({PYPI})(?:\[[\w,.-]*\])?(?:(?:==|@)([\w.!+-]+))?", rest[0]) if rest else None
        return out | {"kind": "pypi", "name": normal_name(found[1]), "version": found[2] if found[2] != "latest" else None} if found else failed("bad_uvx")
    if len(words) > 1:
        return failed("not_understood")
    try:
        parts = urlsplit(text if "://" in text else f"https://{text}")
    except ValueError:
        return failed("not_understood")
    if parts.scheme != "https" or (parts.hostname or "").removeprefix("www.") != "github.com":
        return failed("unsupported_host" if parts.hostname and "." in parts.hostname else "not_understood")
    path = [p for p in parts.path.split("/") if p]
    if len(path) < 2:
        return failed("no_repository")
    owner, repo = path[0], path[1].removesuffix(".git")
    if not re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})", owner) or not re.fullmatch(r"[A-Za-z0-9._-]{1,100}", repo) or repo in (".", ".."):
        return failed("bad_repository")
    tree = "/".join(path[3:]) if len(path) > 3 and path[2] in ("tree", "blob") else None
    return out | {"kind": "github", "owner": owner, "repo": repo, "ref_path": tree}


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


@F.pandas_udf(PARSED)
def parsed(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in text], columns=PARSED.names)


def valid_selection(text: Column) -> Column:
    """A relative folder of plain names."""
    plain = F.forall(F.split(text, "/"), lambda s: s.rlike(r"^[\w.@+-]+\z") & ~s.isin(".", ".."))
    return F.coalesce(plain & (F.length(text) <= 200), F.lit(False))


def tree_reference(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """requests (request, ref_path) with ref and folder: the shortest prefix of the path that is a ref of refs (request, ref)."""
    parts = F.split("ref_path", "/")
    tried = requests.where("ref_path IS NOT NULL").select("request", "ref_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("ref"))
    first = tried.join(refs, ["request", "ref"], "left_semi").groupBy("request").agg(F.min_by("ref", F.length("ref")).alias("ref"))
    out = requests.join(first, "request", "left")
    return out.withColumn("folder", F.when(F.length("ref_path") > F.length("ref"), F.substr("ref_path", F.length("ref") + 2)))
