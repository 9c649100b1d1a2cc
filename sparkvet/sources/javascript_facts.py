"""Facts of JavaScript and TypeScript source files, read without running them. Rows are those of the Python reader; places are characters.

A file is cut into tokens, brackets are matched, and calls, functions, imports and tools are told by the tokens around a bracket: no grammar, no
recursion over the tree, so deep or odd files cost no stack. Files whose brackets or literals don't close give one parse_error. Data flow is
read in part: each file gives a flow_gap, so that no package passes for fully read because of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from sparkvet.sources import javascript_flow

#: Words after which a slash starts a pattern, and words that a bracket may follow without being a call.
BEFORE_PATTERN = ["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"]
NO_CALL = ["if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "void", "throw", "yield", "case", "in", "of", "delete", "else", "do", "super", "new", "async"]
#: Functions of the file system by what they do, without the Sync at their end.
FILES = {
    "fs_read": ["readFile", "readdir", "createReadStream", "opendir", "read", "readJson", "readlink"],
    "fs_write": ["writeFile", "appendFile", "mkdir", "copyFile", "rename", "createWriteStream", "chmod", "chown", "symlink", "link", "truncate", "write", "writeJson", "outputFile", "copy", "move", "ensureDir", "cp", "utimes", "mkdtemp"],
    "fs_delete": ["unlink", "rm", "rmdir", "remove", "emptyDir"],
}
FILE_MODULES = ["fs", "fs.promises", "fs-extra", "graceful-fs"]
#: Capability of a qualified name; a trailing * stands for the rest.
IMPORTED = [
    ("child_process.*", "exec"), ("execa*", "exec"), ("cross-spawn*", "exec"), ("shelljs.*", "exec"), ("node-pty.*", "exec"), ("zx.*", "exec"), ("vm.*", "dynamic_code"), ("vm2.*", "dynamic_code"),
    ("axios*", "network"), ("got*", "network"), ("node-fetch*", "network"), ("undici*", "network"), ("superagent*", "network"), ("ky*", "network"), ("request*", "network"), ("nodemailer.*", "network"),
    ("http.request", "network"), ("http.get", "network"), ("https.request", "network"), ("https.get", "network"), ("net.connect", "network"), ("net.createConnection", "network"), ("tls.connect", "network"), ("ws*", "network"), ("process.kill", "process_control"),
]
GLOBAL = {"eval": "dynamic_code", "Function": "dynamic_code", "fetch": "network", "globalThis.fetch": "network", "WebSocket": "network", "XMLHttpRequest": "network", "EventSource": "network", "process.kill": "process_control"}
SENDING = ("post", "put", "patch", "send", "sendMail")
HINTS = {"readOnlyHint", "openWorldHint", "destructiveHint", "idempotentHint", "title"}

SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/|\A#![^\n]*)+", re.S)
NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d][\w$]*")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+=|\+\+|--|.", re.S)
ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
PAIRS = {")": "(", "]": "[", "}": "{"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if len(c) > 1 and c[0] in "ux":
            code = int(c[1:].strip("{}"), 16)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(c, c)

    return ESCAPE.sub(one, text)


def module_name(text: str) -> str:
    """node:fs/promises and fs/promises are fs.promises; scoped names and paths stay."""
    text = text.removeprefix("node:")
    return text if text.startswith((".", "@", "/")) else text.replace("/", ".")


def lex(s: str) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    """Tokens (kind, text, start, end), and for each bracket the index of its partner (-1 for others). ValueError where something stays open."""
    tokens, partner, stack, i = [], [], [], 0

    def put(kind: str, end: int) -> None:
        nonlocal i
        tokens.append((kind, s[i:end], i, end))
        partner.append(-1)
        i = end

    def close(opened: tuple[str, ...]) -> None:
        if not stack or tokens[stack[-1]][1] not in opened:
            raise ValueError(f"unmatched bracket at {tokens[-1][2]}")
        j = stack.pop()
        partner[j], partner[-1] = len(tokens) - 1, j

    while i < len(s):
        if stack and tokens[stack[-1]][1] == "`":
            end = CHUNK.match(s, i).end()
            if end > i:
                put("chunk", end)
            elif s[i] == "`":
                put("close", i + 1)
                close(("`",))
            elif s.startswith("${", i):
                put("open", i + 2)
                stack.append(len(tokens) - 1)
            else:
                raise ValueError("template ends in an escape")
            continue
        if m := SPACE.match(s, i):
            i = m.end()
            continue
        c = s[i]
        if m := NAME.match(s, i):
            put("name", m.end())
        elif c.isdigit():
            put("number", re.compile(r"[\w.]+").match(s, i).end())
        elif c in "\"'" and (m := STRING.match(s, i)):
            put("string", m.end())
        elif c in "([{`":
            put("open", i + 1)
            stack.append(len(tokens) - 1)
        elif c in ")]}":
            put("close", i + 1)
            close((PAIRS[c], "${") if c == "}" else (PAIRS[c],))
        elif s.startswith("/*", i):
            raise ValueError("comment stays open")
        elif c == "/" and (not tokens or tokens[-1][0] == "punct" or tokens[-1][0] == "open" or tokens[-1][1] in BEFORE_PATTERN) and (m := PATTERN.match(s, i)):
            put("pattern", m.end())
        else:
            put("punct", PUNCT.match(s, i).end())
    if stack:
        raise ValueError(f"bracket at {tokens[stack[-1]][2]} stays open")
    return tokens, partner


class _File:
    def __init__(self, pkg: str, path: str, source: str):
        self.pkg, self.path, self.rows = pkg, path, []
        self.tokens, self.partner = lex(source)
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ends: dict[int, int] = {}
        self.imports: dict[str, str] = {}
        self.values: dict[str, tuple[int, int]] = {}
        self.named: dict[str, tuple[int, int, tuple[int, int]]] = {}
        self.begins: dict[int, tuple[int, int, tuple[int, int]]] = {}

    def t(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.tokens[i][2])

    def add(self, fact: str, first: int, last: int, name: str | None = None, detail: str | None = None, **extra: str | None) -> None:
        self.rows.append((self.pkg, self.path, fact, name, detail, self.tokens[first][2], self.tokens[last][3], self.line(first), {k: v for k, v in extra.items() if v is not None}))

    def after(self, i: int) -> int:
        """The index after a token, or after the bracket that it opens."""
        return self.partner[i] + 1 if self.kind(i) == "open" else i + 1

    def until(self, i: int) -> int:
        """Where the expression at i ends: at a comma, a semicolon, a closing bracket, or a line that starts a statement."""
        start, passed = i, []
        while i < len(self.tokens) and self.kind(i) != "close" and self.t(i) not in (",", ";"):
            fresh = i > start and self.line(i) > bisect_right(self.lines, self.tokens[i - 1][2]) and self.kind(i) in ("name", "string") and self.kind(i - 1) != "punct" and self.t(i - 1) not in BEFORE_PATTERN and self.t(i) not in ("instanceof", "in", "of", "as", "satisfies")
            if fresh:
                break
            if i in self.ends:
                i = self.ends[i]
                break
            passed.append(i)
            i = self.after(i)
        self.ends.update(dict.fromkeys(passed, i))  # each place of the expression ends there too
        return i

    def parts(self, opened: int) -> list[tuple[int, int]]:
        """Spans between the commas of a bracket."""
        out, i, end = [], opened + 1, self.partner[opened]
        start = i
        while i <= end:
            if i == end or self.t(i) == ",":
                if i > start:
                    out.append((start, i))
                start = i + 1
            i = self.after(i) if i < end else i + 1
        return out

    def text(self, span: tuple[int, int] | None, depth: int = 0) -> tuple[str | None, bool]:
        """(text with {} for unknown parts, whether parts are unknown) of a sum of literals, templates and constants."""
        if span is None or depth > 5:
            return None, True
        i, end = span
        out, known, dynamic = [], False, False
        while i < end:
            j = i
            while j < end and self.t(j) != "+":
                j = self.after(j)
            if j == i + 1 and self.kind(i) == "string":
                out.append(unescape(self.t(i)[1:-1]))
                known = True
            elif self.t(i) == "`" and self.after(i) == j:
                k = i + 1
                while k < self.partner[i]:
                    if self.kind(k) == "chunk":
                        out.append(unescape(self.t(k)))
                    else:
                        value, unknown = self.text((k + 1, self.partner[k]), depth + 1)
                        out.append("{}" if value is None else value)
                        dynamic |= unknown
                    k = self.after(k)
                known = True
            elif j == i + 1 and self.t(i) in self.values:
                value, unknown = self.text(self.values[self.t(i)], depth + 1)
                out.append("{}" if value is None else value)
                known, dynamic = known or value is not None, dynamic or unknown
            else:
                out.append("{}")
                dynamic = True
            i = j + 1
        return ("".join(out), dynamic) if known else (None, True)

    def object(self, span: tuple[int, int] | None, depth: int = 0) -> dict[str, tuple[int, int]] | None:
        """Spans of the values of an object literal, or of a constant that holds one."""
        if span is None or depth > 5:
            return None
        i, end = span
        if end == i + 1 and self.t(i) in self.values:
            return self.object(self.values[self.t(i)], depth + 1)
        if self.t(i) != "{" or self.kind(i) != "open":
            return None
        out = {}
        for a, b in self.parts(i):
            k = a
            while self.t(k) in ("async", "get", "set", "*") and k + 1 < b and self.t(k + 1) not in (":", "(", ","):
                k += 1
            key = self.t(k)[1:-1] if self.kind(k) == "string" else self.t(k)
            if self.t(k + 1) == ":" and k + 1 < b:
                out[key] = (k + 2, b)
            elif self.kind(k) in ("name", "string"):
                out[key] = (a, b)  # a method, or the short form
        return out

    def qualified(self, last: int) -> tuple[str | None, bool, int]:
        """Dotted name that ends at a token, whether its first part is imported, and its first token."""
        names, i = [], last
        while self.kind(i) == "name":
            names.append(self.t(i))
            if self.t(i - 1) not in (".", "?."):
                break
            i -= 2
        if not names or self.kind(i) != "name":
            return (".".join(["", *reversed(names)]) if names else None), False, last
        first = self.imports.get(names[-1])
        return ".".join([first or names[-1], *reversed(names[:-1])]), first is not None, i

    def _bind(self, pattern: tuple[int, int], module: str) -> None:
        i, end = pattern
        if self.t(i) == "{":
            for a, b in self.parts(i):
                a += self.t(a) == "type" and b - a > 1
                self.imports[self.t(b - 1)] = f"{module}.{self.t(a)}"
        elif self.t(i) == "*":
            self.imports[self.t(end - 1)] = module
        elif self.kind(i) == "name":
            self.imports[self.t(i)] = module

    def read_imports(self) -> None:
        for i in range(len(self.tokens)):
            word = self.t(i)
            if self.kind(i) != "name" or self.t(i - 1) in (".", "?."):
                continue
            if word in ("import", "export") and self.t(i + 1) != "(":
                j = i + 1
                while j < min(i + 12, len(self.tokens)) and self.t(j) not in ("from", ";", "=") and self.kind(j) != "string":
                    j = self.after(j)
                at = j + (self.t(j) == "from")
                if self.kind(at) != "string" or word == "export" and self.t(j) != "from":
                    continue
                module = module_name(self.t(at)[1:-1])
                self.add("import", i, at, module)
                k = i + 1 + (self.t(i + 1) == "type" and self.t(i + 2) != "from")
                while word == "import" and k < j:
                    e = k
                    while e < j and self.t(e) != ",":
                        e = self.after(e)
                    self._bind((k, e), module)
                    k = e + 1
            elif word in ("const", "let", "var"):
                j = i + 1
                while self.kind(j) == "name" or self.t(j) in ("{", "["):
                    e = self.after(j)
                    if self.t(e) == ":":  # a type
                        while e < len(self.tokens) and self.t(e) not in ("=", ",", ";") and self.kind(e) != "close":
                            e = self.after(e)
                    if self.t(e) != "=":
                        break
                    end = self.until(e + 1)
                    self._declare((j, j + 1 if self.kind(j) == "name" else self.after(j)), (e + 1, end))
                    if self.t(end) != ",":
                        break
                    j = end + 1

    def _declare(self, target: tuple[int, int], value: tuple[int, int]) -> None:
        i = value[0] + (self.t(value[0]) == "await")
        if self.t(i) in ("require", "import") and self.t(i + 1) == "(" and self.kind(i + 2) == "string":
            rest = [self.t(k) for k in range(self.partner[i + 1] + 1, value[1]) if self.kind(k) == "name"]
            module = ".".join([module_name(self.t(i + 2)[1:-1]), *rest])
            self.add("import", i, self.partner[i + 1], module)
            self._bind(target, module)
        elif self.t(self.partner[value[1] - 1] - 1 if self.kind(value[1] - 1) == "close" else -1) == "promisify" and self.qualified(value[1] - 2)[1]:
            self.imports[self.t(target[0])] = self.qualified(value[1] - 2)[0]  # a promise form of an imported function
        elif self.kind(target[0]) == "name":
            self.values[self.t(target[0])] = value
        name, _, _ = self.qualified(value[1] - 1)
        if name == "process.env" and self.t(target[0]) == "{":
            for a, _ in self.parts(target[0]):
                if self.t(a) != "...":
                    self.add("finding", a, a, "env_read", self.t(a))

    def read_functions(self) -> None:
        for i in range(len(self.tokens)):
            word, name, opened = self.t(i), None, -1
            first = i
            if word == "function" and self.kind(i) == "name":
                j = i + 1 + (self.t(i + 1) == "*")
                name, opened = (self.t(j), j + 1) if self.kind(j) == "name" else (self._target(i), j)
                first = i - (self.t(i - 1) == "async")
            elif word == "=>":
                j = i - 1
                if self.kind(j) != "close" and self.kind(j - 1) == "punct" or self.t(j) in (">", "]", "}"):  # a type of what is returned may stand before the arrow
                    k = j
                    while k > max(i - 40, 0) and not (self.t(k) == ":" and self.t(k - 1) == ")"):
                        k -= 1
                    j = k - 1 if self.t(k) == ":" and self.t(k - 1) == ")" else j
                if self.t(j) != ")" and (j < 0 or self.kind(j) != "name"):
                    continue  # no parameters: not a function
                first = self.partner[j] if self.t(j) == ")" else j
                opened = first if self.t(j) == ")" else -1
                first -= self.t(first - 1) == "async"
                name = self._target(first)
                body = self.partner[i + 1] + 1 if self.t(i + 1) == "{" else self.until(i + 1)
                self._function(first, max(body - 1, i), name, (opened + 1, self.partner[opened]) if opened >= 0 else (j, j + 1))
                continue
            elif self.kind(i) == "name" and self.t(i + 1) == "(" and word not in NO_CALL and self.t(i - 1) not in (".", "?.", "function", "new", "*"):
                name, opened = word, i + 1
                first = i - (self.t(i - 1) == "async")
            if opened < 0 or self.t(opened) != "(":
                continue
            b = self.partner[opened] + 1
            if self.t(b) == ":":  # a type
                b += 1
                while b < len(self.tokens) and self.t(b) not in ("{", ";", ",", "=>", "=") and self.kind(b) != "close":
                    b = self.after(b)
            if self.t(b) == "{":
                self._function(first, self.partner[b], name, (opened + 1, self.partner[opened]))

    def _target(self, first: int) -> str | None:
        """The name that a function expression is given to."""
        return self.t(first - 2) if self.t(first - 1) in ("=", ":") and self.kind(first - 2) == "name" else None

    def _function(self, first: int, last: int, name: str | None, parameters: tuple[int, int]) -> None:
        self.add("function", first, last, name)
        self.begins[first] = (first, last, parameters)
        if name:
            self.named.setdefault(name, self.begins[first])

    def handler(self, span: tuple[int, int] | None) -> int | None:
        """First token of the function that an expression is, or names."""
        if span is None:
            return None
        if span[0] in self.begins:
            return span[0]
        last = self.t(span[1] - 1)
        if all(self.kind(k) == "name" or self.t(k) == "." for k in range(*span)) and last in self.named:
            return self.named[last][0]
        return next((k for k in range(*span) if k in self.begins), None)  # a function within a wrapper

    def parameters(self, span: tuple[int, int] | None, depth: int = 0) -> list[str]:
        found = self.object(span)
        if found is not None:
            return self.parameters(found["properties"], depth + 1) if "properties" in found and depth < 5 else list(found)
        if span and depth < 5:  # z.object({...}) and what follows it
            for k in range(*span):
                if self.t(k) == "(" and self.t(k - 1) in ("object", "strictObject") and self.parts(k):
                    return self.parameters(self.parts(k)[0], depth + 1)
        return []

    def tool(self, at: int, last: int, name: str | None, words: dict[str, tuple[int, int]], schema: tuple[int, int] | None, handler: int | None, **extra: str) -> None:
        if name is None:
            return self.add("flow_gap", at, last, "tool_name_unknown")
        description, dynamic = self.text(words.get("description")) if "description" in words else ("", False)
        hints = (self.object(words.get("annotations")) or {}) if "annotations" in words else {}
        hint = lambda k: None if k not in hints else self.t(hints[k][0]) if hints[k][1] == hints[k][0] + 1 and self.t(hints[k][0]) in ("true", "false") else "computed"
        title = self.text(words["title"] if "title" in words else hints.get("title"))[0]
        first, end = (handler, self.begins[handler][1]) if handler is not None else (at, last)
        if handler is None and "listed" not in extra:
            self.add("flow_gap", at, last, "handler_unknown", name)
        self.add("tool", first, end, name, description, dynamic=str(dynamic).lower(), read_only=hint("readOnlyHint"), open_world=hint("openWorldHint"), title=title, parameters=",".join(self.parameters(schema)), **extra)

    def read_calls(self) -> None:
        for i in range(len(self.tokens)):
            if self.kind(i) == "string":
                value = unescape(self.t(i)[1:-1])
                if value:
                    self.add("string", i, i, None, value)
            elif self.kind(i) == "chunk":
                self.add("string", i, i, None, unescape(self.t(i)))
            elif self.t(i) == "{" and self.kind(i) == "open" and self.t(i - 1) not in (")", "=>"):
                found = self.object((i, self.partner[i] + 1)) or {}
                if "name" in found and "inputSchema" in found:
                    self.tool(i, self.partner[i], self.text(found["name"])[0], found, found["inputSchema"], None, listed="true")
            elif self.t(i) == "env" and self.t(i - 1) == "." and self.t(i - 2) == "process":
                key = self.t(i + 2) if self.t(i + 1) in (".", "?.") and self.kind(i + 2) == "name" else self.text((i + 2, self.partner[i + 1]))[0] if self.t(i + 1) == "[" else None
                if key or self.t(i + 1) == "[":
                    self.add("finding", i, i, "env_read", key if key and "{}" not in key else None)
            elif self.t(i) == "case" and self.kind(i + 1) == "string" and self.t(i + 2) == ":":
                end = i + 3
                while end < len(self.tokens) and self.kind(end) != "close" and not (self.t(end) in ("case", "default") and end > i + 3):
                    end = self.after(end)
                self._dispatch(i + 1, i, end - 1)
            elif self.t(i) in ("===", "==") and (self.kind(i + 1) == "string" or self.kind(i - 1) == "string"):
                s = i + 1 if self.kind(i + 1) == "string" else i - 1
                j = max(i, s) + 1
                if self.t(j) == ")" and self.t(self.partner[j] - 1) == "if":
                    end = self.partner[j + 1] if self.t(j + 1) == "{" else self.until(j + 1) - 1
                    self._dispatch(s, self.partner[j] - 1, end)
            elif self.t(i) == "(" and self.kind(i - 1) == "name" and self.t(i - 1) not in NO_CALL and self.t(self.partner[i] + 1) != "{":
                self._call(i)

    def _dispatch(self, literal: int, first: int, last: int) -> None:
        self.add("dispatch", first, max(first, last), unescape(self.t(literal)[1:-1]))

    def _call(self, opened: int) -> None:
        name, imported, first = self.qualified(opened - 1)
        last, arguments = self.partner[opened], self.parts(opened)
        if name is None:
            return
        end = name.rpartition(".")[2]
        self.add("call", first, last, end, name, imported=str(imported).lower())
        for a, b in arguments:
            if b == a + 1 and self.kind(a) == "name":
                self.add("call", a, a, self.t(a), self.t(a), imported="argument")
        if "." in name and end in ("tool", "registerTool") and arguments:
            words, schema = {}, None
            middle = arguments[1:-1] if len(arguments) > 1 else []
            for span in middle:
                keys = self.object(span)
                if end == "registerTool" and keys is not None:
                    words, schema = keys, keys.get("inputSchema")
                elif keys is None and self.text(span)[0] is not None:
                    words["description"] = span
                elif keys and set(keys) <= HINTS:
                    words["annotations"] = span
                else:
                    schema = span
            self.tool(first, last, self.text(arguments[0])[0], words, schema, self.handler(arguments[-1]) if len(arguments) > 1 else None)
        elif "." in name and end == "addTool" and arguments:
            words = self.object(arguments[0]) or {}
            self.tool(first, last, self.text(words.get("name"))[0], words, words.get("parameters") or words.get("inputSchema"), self.handler(words.get("execute") or words.get("handler")))
        elif end == "setRequestHandler" and len(arguments) > 1 and "CallTool" in self.t(arguments[0][1] - 1):
            h = self.handler(arguments[1])
            if h is not None:
                self.add("call_handler", h, self.begins[h][1])
        self._finding(first, last, name, imported, arguments)

    def capability(self, name: str, imported: bool) -> str | None:
        """What a call of a qualified name can do."""
        if not imported:
            return GLOBAL.get(name)
        module, _, end = name.rpartition(".")
        if module in FILE_MODULES:
            return next((c for c, names in FILES.items() if end.removesuffix("Sync") in names), None)
        hit = lambda p: name == p.rstrip("*.") or name.startswith(p[:-1].rstrip(".") + ".") if p.endswith("*") else name == p
        return next((c for p, c in IMPORTED if hit(p)), None)

    def _finding(self, first: int, last: int, name: str, imported: bool, arguments: list[tuple[int, int]]) -> None:
        end = name.rpartition(".")[2]
        found = self.capability(name, imported)
        if name in ("require", "import") and not imported:
            value, dynamic = self.text(arguments[0] if arguments else None)
            found = "dynamic_code" if dynamic and not (value or "").endswith(".json") else None
        if found is None:
            return
        extra = {}
        if found == "network":
            options = next((o for a in reversed(arguments) if (o := self.object(a)) is not None), {})
            first_is_options = bool(arguments) and self.object(arguments[0]) is not None
            span = options.get("url") if first_is_options else arguments[0] if arguments else None
            url, dynamic = self.text(span)
            method = (self.text(options.get("method"))[0] or "").upper()
            extra = request(url, dynamic, bool(arguments), end in SENDING or method in ("POST", "PUT", "PATCH") or bool({"body", "data", "json", "form"} & set(options)))
        self.add("finding", first, last, found, name, **extra)


def request(url: str | None, dynamic: bool, given: bool, sends: bool) -> dict[str, str | None]:
    """What a request tells of its address: the host counts only where it is written out whole."""
    whole = url is not None and url.startswith(("http://", "https://"))
    rest = url.split("//", 1)[1] if whole else ""
    host = re.split(r"[/?#]", rest)[0].split(":")[0].lower()
    known = whole and host and "{}" not in host and (re.search(r"[/?#]", rest) or not dynamic)
    return {"url_kind": "unknown" if not given else "dynamic" if dynamic else "literal", "url_host": host if known else None, "has_address": str(given).lower(), "sends": str(sends).lower()}


def facts_of(pkg: str, path: str, source: bytes) -> list[tuple]:
    text = source.decode("utf-8", "replace")
    try:
        reader = _File(pkg, path, text)
    except ValueError as e:
        return [(pkg, path, "parse_error", type(e).__name__, str(e)[:200], 0, len(text), 0, {})]
    reader.read_imports()
    reader.read_functions()
    reader.read_calls()
    try:
        found, gaps = javascript_flow.flows(reader)
    except (RecursionError, MemoryError) as e:
        found, gaps = [], [type(e).__name__]
    for gap in [*gaps, *(["language"] if reader.begins else [])]:
        reader.rows.append((pkg, path, "flow_gap", gap, None, 0, len(text), 0, {}))
    reader.rows += [flow_row(pkg, path, tool, h) for tool, h in found]
    return reader.rows


def flow_row(pkg: str, path: str, tool: str | None, h: javascript_flow.Hit) -> tuple:
    extra = {"tool": tool, "kind": h.label.kind, "pasted": str(h.label.pasted).lower(), "role": h.role, "path_kinds": ",".join(h.path_kinds), "steps": str(h.steps)}
    return pkg, path, "flow", h.sink, h.label.source, h.offset, h.offset, h.line, {k: v for k, v in extra.items() if v}
