"""Source files that do not parse: lexers and the generalised LL parse of each file in its language's dialects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grammars
from tessera.llm.gll import Grammar
from tessera.sources.tables import clean_path

#: Language of each supported extension.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "java": "java", "rs": "rust"}


class LexError(Exception):
    pass


@dataclass
class Language:
    """grammar text, dialects, token pattern, the words and signs that are terminals of their own."""

    text: str
    starts: list[str]
    pattern: re.Pattern
    words: set[str] = field(default_factory=set)
    signs: dict[str, str] = field(default_factory=dict)
    bom: bool = True
    _grammar: Grammar | None = None

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            self._grammar = Grammar(self.text, self.starts)
        return self._grammar


def _kinds(words: str, kind: str) -> dict[str, str]:
    return {w: kind for w in words.split()}


def _pattern(*parts: str, flags: int = 0) -> re.Pattern:
    return re.compile("|".join(parts), flags)


_ID = r"(?P<NAME>[^\W\d]\w*)"

# --- Go ---

GO = Language(
    grammars.GO,
    ["File", "Classic"],
    _pattern(
        r"(?P<ws>[ \t\r]+)", r"(?P<line>\n)", r"(?P<comment>//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)", _ID,
        r"(?P<NUMBER>0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?i?(?!\w)|0[bB](?:_?[01])+i?(?!\w)|0[oO](?:_?[0-7])+i?(?!\w)|(?:\d(?:_?\d)*+\.?+(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?(?!\w))",
        r'(?P<STRING>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`)',
        r"(?P<CHAR>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')",
        r"(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    ),
    set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    _kinds("== != < <= > >= && || / % << >> &^", "BIN") | _kinds("+= -= *= /= %= &= |= ^= <<= >>= &^=", "AUG"),
)
_GO_ENDS = {"NAME", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_go(text: str, lang: Language) -> list[int]:
    ids = lang.grammar.terminals
    semicolon, ends = ids[";"], {ids[x] for x in _GO_ENDS}
    out: list[int] = []
    at = 0
    for m in lang.pattern.finditer(text):
        if m.start() != at:
            raise LexError(at)
        at = m.end()
        kind = m.lastgroup
        if kind == "ws":
            continue
        if kind == "line" or kind == "comment":
            if out and out[-1] in ends and (kind == "line" or "\n" in m[0]):
                out.append(semicolon)
            continue
        word = m[0]
        if kind == "NAME":
            out.append(ids[word] if word in lang.words else ids["NAME"])
        elif kind == "op":
            out.append(ids[lang.signs.get(word, word)])
        else:
            out.append(ids[kind])
    if at != len(text):
        raise LexError(at)
    if out and out[-1] in ends:
        out.append(semicolon)
    return out


# --- Python ---

_PY_STRING = (
    r"(?P<STRING>(?i:[rbuf]|[bf]r|r[bf])?(?:"
    r'"""(?:[^"\\]|\\(?:.|\n)|"(?!""))*"""|' r"'''(?:[^'\\]|\\(?:.|\n)|'(?!''))*'''|"
    r'"(?!"")(?:[^"\\\n]|\\(?:.|\n))*"|' r"'(?!'')(?:[^'\\\n]|\\(?:.|\n))*'))"
)
PYTHON = Language(
    grammars.PYTHON,
    ["File"],
    _pattern(
        r"(?P<ws>[ \t\f]+)", r"(?P<line>\n)", r"(?P<comment>\#[^\n]*)", r"(?P<join>\\\n)", _PY_STRING, _ID,
        r"(?P<NUMBER>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?!\.))(?!\w))",
        r"(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:;.=])",
    ),
    set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()),
    _kinds("< > <= >= == !=", "CMP") | _kinds("// % << >> & ^", "BIN") | _kinds("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "AUG"),
)


def lex_python(text: str, lang: Language) -> list[int]:
    if "\x00" in text:
        raise LexError(text.index("\x00"))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    ids = lang.grammar.terminals
    newline, indent, dedent, name = ids["NEWLINE"], ids["INDENT"], ids["DEDENT"], ids["NAME"]
    out: list[int] = []
    levels = [0]
    depth, at, fresh, column = 0, 0, True, 0
    for m in lang.pattern.finditer(text):
        if m.start() != at:
            raise LexError(at)
        at = m.end()
        kind = m.lastgroup
        if kind == "ws":
            if fresh:
                column = len(m[0].rpartition("\f")[2].expandtabs(8))
            continue
        if kind == "comment" or kind == "join":
            continue
        if kind == "line":
            if not fresh and not depth:
                out.append(newline)
            if not depth:
                fresh, column = True, 0
            continue
        if fresh and not depth:
            if column > levels[-1]:
                levels.append(column)
                out.append(indent)
            while column < levels[-1]:
                levels.pop()
                out.append(dedent)
            if column != levels[-1]:
                raise LexError(at)
        fresh = False
        word = m[0]
        if kind == "NAME":
            out.append(ids[word] if word in lang.words else name)
        elif kind == "op":
            if word in "([{":
                depth += 1
            elif word in ")]}":
                depth = max(0, depth - 1)
            out.append(ids[lang.signs.get(word, word)])
        else:
            out.append(ids[kind])
    if at != len(text):
        raise LexError(at)
    if depth:
        raise LexError(at)
    if not fresh:
        out.append(newline)
    out += [dedent] * (len(levels) - 1)
    return out


# --- JavaScript ---

JAVASCRIPT = Language(
    grammars.JAVASCRIPT,
    ["Module", "Script"],
    _pattern(
        r"(?P<ws>[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)", r"(?P<line>[\r\n\u2028\u2029]+)", r"(?P<comment>//[^\r\n\u2028\u2029]*)", r"(?P<block>/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)",
        r"(?P<NAME>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)", r"(?P<PRIVATE>\#[^\W\d][\w$]*)",
        r"(?P<NUMBER>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*+\.?+(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$]))",
        r'(?P<STRING>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|' r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')",
        r"(?P<tick>`)",
        r"(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:,;.()\[\]{}@])",
    ),
    set("let static async of get set from as yield await target accessor var const function class extends if else for while do return break continue throw try catch finally switch case default new typeof in instanceof this super import export with debugger null true false void delete".split()),
    _kinds("< > <= >= == != === !== && || ?? / % ** << >> >>> & | ^", "BIN") | _kinds("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", "AUG"),
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-zA-Z]*")
_JS_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_RESERVED = {"enum"}
#: Words after which a slash begins a regular expression.
_JS_BEFORE_REGEX = set("return typeof instanceof in of new delete void throw case do else yield await".split())


def lex_javascript(text: str, lang: Language) -> tuple[list[int], list[bool]]:
    ids = lang.grammar.terminals
    out: list[int] = []
    lines: list[bool] = []
    if text.startswith("#!"):
        text = "//" + text[2:]
    at, ended, value_before = 0, False, False
    braces: list[str] = []  # what each open brace is: a block or object, or the hole of a template
    match = lang.pattern.match
    restricted = False

    def put(kind: str) -> None:
        nonlocal ended, restricted
        if restricted and ended:
            out.append(ids["INSERTED"])
            lines.append(False)
        restricted = False
        out.append(ids[kind])
        lines.append(ended)
        ended = False

    def chunk(first: bool) -> None:
        """A template's text from after its backtick or hole up to the next hole or its end."""
        nonlocal at, value_before
        at = _JS_CHUNK.match(text, at).end()
        if text.startswith("`", at):
            at += 1
            put("TEMPLATE" if first else "TEMPLATE_TAIL")
            value_before = True
        elif text.startswith("${", at):
            at += 2
            braces.append("hole")
            put("TEMPLATE_HEAD" if first else "TEMPLATE_MIDDLE")
            value_before = False
        else:
            raise LexError(at)

    while at < len(text):
        if text[at] == "/" and not value_before and (r := _JS_REGEX.match(text, at)):
            put("REGEX")
            at, value_before = r.end(), True
            continue
        m = match(text, at)
        if not m:
            raise LexError(at)
        kind, word = m.lastgroup, m[0]
        at = m.end()
        if kind == "ws" or kind == "comment":
            continue
        if kind == "line":
            ended = True
        elif kind == "block":
            ended = ended or "\n" in word
        elif kind == "tick":
            chunk(True)
        elif kind == "NAME":
            if word in _JS_RESERVED:
                put("RESERVED")
                value_before = False
            elif word in lang.words:
                put(word)
                value_before = word not in _JS_BEFORE_REGEX and word not in ("if", "while", "for", "with")
                restricted = word in ("return", "break", "continue", "yield") and not (len(out) > 1 and out[-2] == ids["."])
            else:
                put("NAME")
                value_before = True
        elif kind == "op":
            if word == "}" and braces and braces[-1] == "hole":
                braces.pop()
                chunk(False)
                continue
            if word == "{":
                braces.append("{")
            elif word == "}":
                if braces:
                    braces.pop()
            if word in ("++", "--"):
                after_value = value_before and not ended
                put(word if after_value or not ended else word + "n")
                value_before = after_value
                continue
            put(lang.signs.get(word, word) if word != "@" else "RESERVED")
            value_before = word in (")", "]", "}")
        else:
            put(kind)
            value_before = True
    return out, lines


# --- Java ---

_ESC = r"\\(?:[btnfrs0-7\"'\\]|u+[0-9a-fA-F]{4}|\n)"
JAVA = Language(
    grammars.JAVA,
    ["Unit", "Modular"],
    _pattern(
        r"(?P<ws>[ \t\r\n\f]+|\x1a\Z)", r"(?P<comment>//[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)", r"(?P<NAME>(?:[^\W\d]|\$)(?:\w|\$)*)",
        r"(?P<number>(?:0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*\.?|(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?\.[0-9a-fA-F](?:_*[0-9a-fA-F])*)[pP][+-]?\d+[fFdD]?|0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdD]?|\d(?:_*\d)*(?:[eE][+-]?\d+)?[fFdDlL]?(?!\.))(?!\w))",
        r'(?P<block>"""[ \t\f]*(?:\r\n|\r|\n)(?:[^"\\]|\\(?:.|\n)|"(?!""))*""")',
        r'(?P<string>"(?!"")(?:[^"\\\r\n]|' + _ESC + r')*")', r"(?P<char>'(?:[^'\\\r\n]|\\[0-3]?[0-7]{1,2}|" + _ESC + r")')",
        r"(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:,;.()\[\]{}@])",
    ),
    set("record var yield sealed permits open module requires transitive exports opens to uses provides with when non package import static public protected private abstract final native synchronized transient volatile strictfp default class extends implements interface enum throws this super void new if else while do for switch case return break continue throw assert try catch finally instanceof".split()),
    _kinds("== != <= << && || / % ^", "BIN") | _kinds("+= -= *= /= %= &= |= ^= <<=", "AUG"),
    bom=False,
)
_JAVA_PRIMITIVE = set("boolean byte short int long char float double".split())
_JAVA_LITERAL = {"true", "false", "null"}
_JAVA_RESERVED = {"goto", "const", "_"}


def lex_java(text: str, lang: Language) -> list[int]:
    ids = lang.grammar.terminals
    out: list[int] = []
    at = 0
    for m in lang.pattern.finditer(text):
        if m.start() != at:
            raise LexError(at)
        at = m.end()
        kind, word = m.lastgroup, m[0]
        if kind == "ws" or kind == "comment":
            continue
        if kind == "NAME":
            if word in lang.words:
                out.append(ids[word])
            elif word in _JAVA_PRIMITIVE:
                out.append(ids["PRIMITIVE"])
            elif word in _JAVA_LITERAL:
                out.append(ids["LITERAL"])
            elif word in _JAVA_RESERVED and word != "_":
                raise LexError(m.start())
            else:
                out.append(ids["NAME"])
        elif kind == "op":
            out.append(ids[lang.signs.get(word, word)])
        else:
            out.append(ids["LITERAL"])
    if at != len(text):
        raise LexError(at)
    return out


# --- Rust ---

RUST = Language(
    grammars.RUST,
    ["File", "Later"],
    _pattern(
        r"(?P<ws>[ \t\r\n\v\f\u0085\u200e\u200f\u2028\u2029]+)", r"(?P<comment>//[^\n]*)", r"(?P<block>/\*)",
        r'(?P<raw>(?:b|c)?r(?P<hashes>\#*)")', r'(?P<STRING>(?:b|c)?"(?:[^"\\]|\\[\s\S])*")', r"(?P<CHAR>b?'(?:[^'\\\n\r\t]|\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')",
        r"(?P<LIFETIME>'(?:r\#)?[^\W\d]\w*(?!'))", r"(?P<NAME>(?:r\#)?[^\W\d]\w*)",
        r"(?P<NUMBER>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?(?!\w))",
        r"(?P<op><<=|\.\.\.|\.\.=|->|=>|::|\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!<>=?:,;.()\[\]{}@\#~$])",
    ),
    set("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield union auto macro_rules default raw safe".split()),
    _kinds("== != <= << / % ^", "BIN") | _kinds("+= -= *= /= %= &= |= ^= <<=", "AUG"),
)
_RUST_NEST = re.compile(r"/\*|\*/")


def lex_rust(text: str, lang: Language) -> list[int]:
    ids = lang.grammar.terminals
    out: list[int] = []
    match = lang.pattern.match
    at = 0
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") % (len(text) + 1)
    while at < len(text):
        m = match(text, at)
        if not m:
            raise LexError(at)
        kind, word = m.lastgroup, m[0]
        if kind == "hashes":
            kind = "raw"
        at = m.end()
        if kind == "ws" or kind == "comment":
            continue
        if kind == "block":
            depth = 1
            while depth:
                n = _RUST_NEST.search(text, at)
                if not n:
                    raise LexError(at)
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
        elif kind == "raw":
            end = text.find('"' + m["hashes"], at)
            if end < 0:
                raise LexError(at)
            at = end + 1 + len(m["hashes"])
            out.append(ids["STRING"])
        elif kind == "NAME":
            out.append(ids["_"] if word == "_" else ids[word] if word in lang.words else ids["NAME"])
        elif kind == "op":
            word = lang.signs.get(word, word)
            out.append(ids[word] if word in ids else ids["BIN"])
        else:
            out.append(ids[kind])
    return out


SUPPORTED = {"go": (GO, lex_go), "python": (PYTHON, lex_python), "javascript": (JAVASCRIPT, lex_javascript), "java": (JAVA, lex_java), "rust": (RUST, lex_rust)}


def language_of(path: str) -> str | None:
    """Language by the extension of the path, None if it isn't supported."""
    return LANGUAGES.get(path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None


def parses(language: str, text: str) -> bool:
    """Whether some dialect of the language accepts the text as it stands."""
    lang, lex = SUPPORTED[language]
    if text.startswith("\ufeff"):
        if not lang.bom:
            return False
        text = text[1:]
    try:
        tokens = lex(text, lang)
    except LexError:
        return False
    g = lang.grammar
    if language == "javascript":
        return g.recognise_with_insertion(*tokens, g.terminals["INSERTED"], g.terminals["}"]) < 0
    return g.recognise(tokens) < 0


# --- files --------------------------------------------------------------------------------------------------------


def parsed(sources: DataFrame) -> DataFrame:
    """path, repo, language, ok: one row per path with a supported extension; NULL paths and contents are left out.

    Equal contents of a language are parsed once; if a path comes with several contents, it is ok when all of them are.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]
    rows = sources.where("path IS NOT NULL AND content IS NOT NULL").select(clean_path("path").alias("path"), "content").withColumn("language", language).where("language IS NOT NULL")
    by_text = rows.groupBy("language", F.sha2("content", 256).alias("h")).agg(F.first("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"language": b["language"], "h": b["h"], "ok": [parses(x, t) for x, t in zip(b["language"], b["content"])]})

    # texts differ in length and cost: more partitions than cores even the load
    judged = by_text.mapInPandas(run, "language STRING, h STRING, ok BOOLEAN")
    paths = rows.select("path", "language", F.sha2("content", 256).alias("h")).distinct()
    met = paths.join(judged, ["language", "h"]).groupBy("path").agg(F.min("ok").alias("ok"), F.min("language").alias("language"))
    return met.select("path", F.regexp_extract("path", r"^([^:]*):", 1).alias("repo"), "language", "ok")


def rates(files: DataFrame, errors: DataFrame) -> DataFrame:
    """repo, language, files, failed, rate, logged: failing files, and how many of them the indexer's log names."""
    log = errors.where("path IS NOT NULL").select(clean_path("path").alias("path")).distinct().withColumn("_logged", F.lit(1))
    met = files.join(log, "path", "left")
    bad = F.sum((~F.col("ok")).cast("bigint"))
    return met.groupBy("repo", "language").agg(F.count("*").alias("files"), bad.alias("failed"), (bad / F.count("*")).alias("rate"), F.sum(F.when(~F.col("ok"), F.coalesce("_logged", F.lit(0))).otherwise(0)).alias("logged"))
