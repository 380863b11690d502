"""DuckDB counterparts of ``tickwise.functions.text`` (RE2 syntax)."""

PY_WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{PY_WS}+', ''), '{PY_WS}+\\z', '')"


def strip_fence(expr: str) -> str:
    t = py_strip(expr)
    t = f"regexp_replace({t}, '^```json', '')"
    t = f"regexp_replace({t}, '```\\z', '')"
    return py_strip(t)

# Java's (?U)\s (Unicode White_Space) for RE2, which treats \s as ASCII only.
JAVA_WS = (r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&amp;", "&"),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Java (?U) pattern -> RE2: Unicode \\s, \\S and \\d spelled out; \\z kept."""
    pattern = pattern.replace(r"[\s\S]", "(?s:.)")
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nx = pattern[i + 1]
            if nx == "s":
                out.append(f"[{JAVA_WS}]")
            elif nx == "S":
                out.append(f"[^{JAVA_WS}]")
            elif nx == "d":
                out.append(r"\p{Nd}")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        out.append(ch)
        i += 1
    s = "".join(out)
    # a class like [\s廣告] became [[...]廣告]: flatten nested brackets
    return s.replace(f"[[{JAVA_WS}]", f"[{JAVA_WS}").replace(f"[[^{JAVA_WS}]", f"[^{JAVA_WS}")


def decode(expr: str) -> str:
    for ent, ch in ENTITIES:
        expr = f"replace({expr}, {q(ent)}, {q(ch)})"
    return expr


def text_nodes_joined(expr: str, sep_sql: str) -> str:
    nodes = f"regexp_split_to_array(regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>')"
    stripped = f"list_transform({nodes}, lambda x: {py_strip(decode('x'))})"
    return f"array_to_string(list_filter({stripped}, lambda x: x <> ''), {sep_sql})"


def drop_elements(expr: str, tags) -> str:
    for t in tags:
        expr = f"regexp_replace({expr}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    return expr


def has_element(expr: str, tag: str) -> str:
    return f"regexp_matches({expr}, '(?is)<{tag}\\b[^>]*>')"


def element_inner(expr: str, tag: str) -> str:
    return f"regexp_extract({expr}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"


def py_lines(expr: str) -> str:
    return (f"regexp_split_to_array(regexp_replace({expr}, '({PY_LINE_BREAK})\\z', ''), "
            f"'{PY_LINE_BREAK}')")
