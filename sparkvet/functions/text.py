"""Text predicates and extractions as column expressions; Java regular expressions, Unicode-aware where words matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

#: Code points that are not shown (zero width, direction controls, tags, variation selectors and fillers).
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}"
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"

#: Tags whose content reads as an instruction to a model.
DIRECTIVE_TAGS = "important|system|instructions?|secret|hidden|admin|assistant|override|directive|note_to_(?:ai|llm|model)"

#: Anything inside a sentence: a period followed by a letter or sign does not end one.
WITHIN = r"(?:[^.!?\n]|\.(?=\S))"
NEGATION = r"(?:do\s+not|don['’]t|never|must\s+not|without|ne\s+(?:jamais|pas)?|n['’])"
INFORM = r"(?:tell|inform|mention|notify|reveal|disclose|show|alert|warn|say|dire|dis|dites|informe[rz]?|mentionne[rz]?|r[ée]v[ée]le[rz]?|montre[rz]?|pr[ée]ven(?:ir|ez))"
AUDIENCE = r"(?:users?|humans?|anyone|anybody|people|person|customers?|utilisat(?:eur|rice)s?|personne|humains?|clients?)"
SENSITIVE_ACTION = r"(?:send|read|upload|forward|copy|delete|execute|run|transmit|exfiltrate|email|envoie[rz]?|lire|lis|copie[rz]?|supprime[rz]?|ex[ée]cute[rz]?|transmet(?:tre|s)?)"
CONTENT = r"(?:contents?|files?|keys?|tokens?|passwords?|credentials?|data|text|contenus?|fichiers?|cl[ée]s?|jetons?|mots?\s+de\s+passe|donn[ée]es)"
TRANSMIT = r"(?:pass|send|include|provide|put|supply|append|attach|submit|upload|return|envoie[rz]?|inclure|inclus|ajoute[rz]?|fournir|mets|mettre|joindre)"
DESTINATION = r"(?:parameter|argument|field|server|tool|url|endpoint|param[èe]tre|champ|serveur|outil)"

#: Sensitive paths: (category, kind, pattern).
SENSITIVE_PATHS = [
    ("ssh_key", "secret", r"(?:~|\$HOME|/home/[^/\s]+|/root)?/?\.ssh(?:/[\w.-]+)?"),
    ("aws_credentials", "secret", r"\.aws/(?:credentials|config)"),
    ("gcloud_credentials", "secret", r"\.config/gcloud(?:/[\w.-]+)?"),
    ("kube_config", "secret", r"\.kube/config"),
    ("docker_config", "secret", r"\.docker/config\.json"),
    ("npm_token", "secret", r"(?<![\w])\.npmrc\b"),
    ("pypi_token", "secret", r"(?<![\w])\.pypirc\b"),
    ("netrc", "secret", r"(?<![\w])[._]netrc\b"),
    ("git_credentials", "secret", r"\.git-credentials\b"),
    ("gnupg", "secret", r"\.gnupg(?:/[\w.-]+)?"),
    ("dotenv", "secret", r"(?<![\w.])\.env(?:\.(?:local|production|development))?(?![\w.])"),
    ("private_key", "secret", r"\bid_(?:rsa|dsa|ecdsa|ed25519)\b"),
    ("shadow", "secret", r"/etc/(?:shadow|passwd)\b"),
    ("browser_profile", "secret", r"(?:Login Data|cookies\.sqlite|logins\.json)\b"),
    ("keychain", "secret", r"\bLibrary/Keychains\b"),
    ("shell_startup", "autostart", r"(?<![\w])\.(?:bashrc|zshrc|profile|bash_profile)\b"),
    ("cron", "autostart", r"/etc/cron[\w.]*|\bcrontab\b"),
    ("systemd_unit", "autostart", r"(?:/etc/systemd/system|\.config/systemd/user)(?:/[\w.-]+)?"),
    ("launch_agent", "autostart", r"\bLibrary/Launch(?:Agents|Daemons)(?:/[\w.-]+)?"),
    ("windows_run", "autostart", r"CurrentVersion\\+Run\b"),
    ("mcp_client_config", "tool_config", r"(?:claude_desktop_config\.json|\.cursor/mcp\.json|\.vscode/mcp\.json|\.codeium/windsurf/mcp_config\.json|(?<![\w])\.mcp\.json)"),
]

#: Configuration paths of clients, first match wins.
CLIENTS = [("claude_desktop_config", "Claude Desktop"), (".cursor", "Cursor"), (".vscode", "VS Code"), ("windsurf", "Windsurf"), (".mcp.json", "project file")]

SECRET_TOKENS = ["SECRET", "TOKEN", "PASSWORD", "PASSWD", "PASSPHRASE", "CREDENTIAL", "CREDENTIALS", "APIKEY", "KEY", "PAT", "PRIVATE"]
SECRET_SUFFIXES = ["SECRET", "TOKEN", "PASSWORD", "KEY"]


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), 0)


def url_host(url: Column) -> Column:
    """Lower-case host of a web address; empty without one."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def urls(text: Column, longest: int = 300) -> Column:
    """Web addresses with a host, without trailing punctuation, cut to `longest`."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[A-Za-z0-9.-]+[^\s\"'<>`]*"), 0)
    tidy = F.transform(found, lambda u: F.substring(F.regexp_replace(u, r"[.,;:!?)\]}]+\z", ""), 1, longest))
    return F.filter(tidy, lambda u: F.regexp_extract(u, r"^https?://([^/:?#]+)", 1).rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\z"))


def fixed_host(template: Column) -> Column:
    """Host of an address with {} for unknown parts: known when it is written out and something follows it, or nothing is unknown."""
    whole = F.regexp_extract(template, r"^https?://([A-Za-z0-9.-]+)(?::\d+)?(?:[/?#]|\z)", 1)
    return F.when(whole != "", F.lower(whole))


def plain_sentences(text: Column) -> Column:
    """Pieces that end behind . ! or ? and white space; empty ones are left out."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def invisible_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{INVISIBLE}]", ""))


def invisible_runs(text: Column) -> Column:
    """Runs of code points that are not shown."""
    return F.regexp_extract_all(text, F.lit(f"[{INVISIBLE}]+"), 0)


def has_bidi(text: Column) -> Column:
    return text.rlike(f"[{BIDI}]")


def hidden_red(text: Column) -> Column:
    """Tags, direction controls or two and more hidden characters in a row, where neither an emoji nor a joining script explains them."""
    stripped = F.regexp_replace(text, r"^\x{FEFF}", "")
    stripped = F.regexp_replace(stripped, r"\x{1F3F4}[\x{E0061}-\x{E007A}]{2,6}\x{E007F}", "")  # flags of regions
    stripped = F.regexp_replace(stripped, r"(?<=[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}])\x{200D}(?=[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}])", "")
    stripped = F.regexp_replace(stripped, r"(?<=[\x{2190}-\x{2BFF}\x{3030}\x{1F000}-\x{1FAFF}0-9#*])\x{FE0F}", "")
    return stripped.rlike(rf"[\x{{E0000}}-\x{{E007F}}{BIDI}]|[{INVISIBLE}]{{2,}}")


def hidden_lone(text: Column) -> Column:
    """A single hidden character that nothing explains."""
    stripped = F.regexp_replace(text, r"^\x{FEFF}", "")
    stripped = F.regexp_replace(stripped, r"(?<=[\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsMalayalam}\p{IsSinhala}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}])[\x{200C}\x{200D}]", "")
    stripped = F.regexp_replace(stripped, r"(?<=[\x{2190}-\x{2BFF}\x{3030}\x{1F000}-\x{1FAFF}0-9#*])\x{FE0F}", "")
    return stripped.rlike(rf"(?<![{INVISIBLE}])[{INVISIBLE}](?![{INVISIBLE}])")


def tag_text(text: Column) -> Column:
    """What tag characters spell in ASCII."""
    tags = F.regexp_extract_all(text, F.lit(r"[\x{E0020}-\x{E007E}]"), 0)
    return F.array_join(F.transform(tags, lambda c: F.translate(c, "".join(chr(0xE0000 + i) for i in range(32, 127)), "".join(map(chr, range(32, 127))))), "")


def is_minified(path: Column, text: Column) -> Column:
    longest = F.array_max(F.transform(F.split(text, "\n"), F.length))
    return F.contains(path, F.lit(".min.")) | (longest > 1000)


def silence_request(text: Column) -> Column:
    """The first piece of text that forbids to inform somebody; empty without one."""
    return F.regexp_extract(text, rf"(?iuU)\b{NEGATION}\s*\b{INFORM}\b{WITHIN}{{0,100}}?\b{AUDIENCE}\b", 0)


def silenced_sensitive_action(text: Column) -> Column:
    """A sentence that asks for silence also names a sensitive action, or refers back to a sentence before that does."""
    request = rf"\b{NEGATION}\s*\b{INFORM}\b{WITHIN}{{0,100}}?\b{AUDIENCE}\b"
    same = rf"\b{SENSITIVE_ACTION}\b{WITHIN}*{request}|{request}{WITHIN}*\b{SENSITIVE_ACTION}\b"
    before = rf"\b{SENSITIVE_ACTION}\b{WITHIN}*[.!?]\s+{WITHIN}*{request}{WITHIN}*\b(?:this|that|it|cela|[çc]a|ceci)\b"
    return text.rlike(rf"(?iuU){same}|{before}")


def transmit_request(text: Column, parameters: Column) -> Column:
    """The first sentence with a content word, a verb of passing on, and a destination or a parameter's name (over two letters)."""
    named = lambda s: F.exists(F.coalesce(parameters, F.array().cast("array<string>")), lambda p: (F.length(p) > 2) & F.contains(F.lower(s), F.lower(p)))
    hit = F.filter(F.split(text, r"[!?\n]+|\.(?=\s|\z)"), lambda s: s.rlike(rf"(?iuU)\b{CONTENT}\b") & s.rlike(rf"(?iuU)\b{TRANSMIT}\b") & (s.rlike(rf"(?iuU)\b{DESTINATION}\b") | named(s)))
    return F.when(F.size(hit) > 0, F.trim(F.element_at(hit, 1)))


def directive_blocks(text: Column) -> Column:
    """HTML comments and instruction-like tags with their content; an unclosed one runs to the end."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<!--.*?(?:-->|\z)|<({DIRECTIVE_TAGS})\b[^>]*>.*?(?:</\1\s*>|\z)"), 0)


def analyzer_talk(text: Column) -> Column:
    """Text that speaks to a scanner or reviewer about the result it should come to."""
    direct = r"\b(?:this\s+(?:tool|server|package|code)\s+is\s+(?:completely\s+|perfectly\s+)?safe|mark\s+(?:this|it)\s+as\s+(?:safe|benign|trusted)|ignore\s+(?:this\s+file|all\s+(?:previous\s+)?(?:findings|warnings|alerts)))\b"
    dismissal = rf"\b(?:scanners?|analy[sz]ers?|auditors?|linters?|security\s+tools?)\b{WITHIN}*\b(?:false\s+positives?|can\s+be\s+ignored|should\s+(?:skip|ignore))\b"
    return F.regexp_extract(text, rf"(?iuU){direct}|{dismissal}", 0)


def sensitive_paths(text: Column) -> Column:
    """array<struct<category, kind, match>>, distinct, in the order of the table."""

    def found(category: str, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), m.alias("match")))

    return F.array_distinct(F.concat(*[found(*row) for row in SENSITIVE_PATHS]))


def client_name(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, name in reversed(CLIENTS):
        out = F.when(F.contains(match, F.lit(part)), name).otherwise(out)
    return out


def is_secret_name(name: Column) -> Column:
    """A name whose words, camel case and separators cut, hold a secret's word, or end in one."""
    cut = F.upper(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    words = F.split(cut, "[^A-Z0-9]+")
    return F.arrays_overlap(words, F.array(*map(F.lit, SECRET_TOKENS))) | F.exists(words, lambda w: (F.length(w) > 4) & w.rlike(f"(?:{'|'.join(SECRET_SUFFIXES)})\\z"))


def pipes_to_shell(command: Column) -> Column:
    return command.rlike(r"(?is)\b(?:curl|wget|iwr|invoke-webrequest)\b.{0,300}?\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b|\b(?:iwr|irm)\b.{0,300}?\|\s*iex\b")


def reaches_network(command: Column) -> Column:
    return command.rlike(r"(?i)\b(?:curl|wget|iwr|invoke-webrequest|git\s+clone|nc|ftp|scp)\b|https?://")


def plain_download(command: Column) -> Column:
    """Host of a command that fetches one written-out address and nothing else; null otherwise."""
    one = F.size(F.regexp_extract_all(command, F.lit(r"https?://\S+"), 0)) == 1
    odd = command.rlike(r"[|;&`<>@]|\$\(|\s(?:-d|--data\S*|-F|--form|-T|--upload-file|--post-\S+|-X)\b")
    fetches = command.rlike(r"^\s*(?:curl|wget)\b")
    return F.when(one & ~odd & fetches, F.nullif(url_host(F.regexp_extract(command, r"https?://\S+", 0)), F.lit("")))


def snippet(line: Column, column: Column, longest: int = 200) -> Column:
    """The stripped line, or `longest` characters around a 0-based column."""
    whole = F.trim(line)
    return F.when(F.length(whole) <= longest, whole).otherwise(F.trim(line.substr(F.greatest(F.lit(1), column - 49), F.lit(longest))))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """60 characters before a match (0-based start), the match, and up to 140 after its start's end, trimmed after cutting."""
    first = F.greatest(F.lit(0), start - 60)
    return F.trim(text.substr(first + 1, end + 140 - first))


def shortened(items: Column, limit: int) -> Column:
    """a, b, +N"""
    rest = F.size(items) - limit
    return F.when(rest > 0, F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.lit(", +"), rest.cast("string"))).otherwise(F.array_join(items, ", "))


def is_request(detail: Column, has_address: Column) -> Column:
    """Not the making of a client, nor an upper-case class without an address."""
    last = F.element_at(F.split(detail, r"\."), -1)
    return ~last.isin("Client", "AsyncClient", "Session", "ClientSession") & (has_address | ~last.rlike("^[A-Z]"))


def allowed_domain(domain: Column, known: Column) -> Column:
    """Equal to a known domain or its parent."""
    return F.exists(known, lambda k: (k == domain) | F.endswith(k, F.concat(F.lit("."), domain)))


def normalized_name(name: Column) -> Column:
    """A Python project's name in its normal form."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def html_comments(text: Column) -> Column:
    """The insides of closed HTML comments."""
    return F.regexp_extract_all(text, F.lit("(?s)<!--(.*?)-->"), 1)
