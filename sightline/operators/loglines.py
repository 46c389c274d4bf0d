"""Log lines of several programs to one record per entry, by shape signatures.

Each line is collapsed to its shape (letters to a, digits to 9, runs of plain words to one). Each distinct shape is resolved
once to an extraction rule, the rules go back to the lines, each rule's expressions cut the fields, and continuation
lines are attached to the entry above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.instants import utc_text, with_instant
from sightline.operators.ordered import last_before
from sightline.session import materialize, small

#: Lines of one window block of a file.
_BLOCK = 16_384

#: (rule, pattern over the shape), first match wins. A shape is: collapsed line ~ number of tabs ~ last character.
LAYOUTS = [
    ("comment", r"^#"),
    ("object_start", r"^\{ ?~"),
    ("object", r'^\{ ?"'),
    ("syslog", r"^<9>a 9:9:9 "),
    ("syslog_iso", r"^<9>9 9-9-9a9:9:9"),
    ("syslog_bare", r"^a 9:9:9 \S+ [^ :\[]+(?:\[9\])?:"),
    ("glog", r"^a9 9:9:9\.9 9 [^\]]*:9\]"),
    ("bracket", r"^\[9-9-9[a ]9:9:9[^\]]*\] ?\["),
    ("dashed", r"^9-9-9[a ]9:9:9(?:[.,]9)?(?:a|[+-]9:?9?)? - "),
    ("columns", r"^9-9-9[a ]9:9:9(?:[.,]9)?(?:a|[+-]9:?9?)? \S"),
    ("pairs", r'^[a9.@-]*a=(?:"|\S)'),
    ("combined", r"^\S+ [^\[]*\[9/a/9:9:9:9"),
    ("tabbed", r"~[1-9]\d*~"),
]
#: Rules whose entries own the lines that follow them.
_MULTILINE = ["bracket", "dashed", "columns", "glog"]
#: Rules with two slots of which one may be the level; what the slots hold tells which.
_SLOTS = ["bracket", "columns", "dashed"]

_LEVELS = [
    ("FATAL", "fatal f critical crit c emerg emergency alert panic"),
    ("ERROR", "error err e severe"),
    ("WARN", "warn warning w"),
    ("INFO", "info information informational notice i n"),
    ("DEBUG", "debug dbg d trace verbose fine finer finest v t"),
]
#: Numeric levels. Syslog severities hold everywhere; the tens are those of Python's logging, in JSON those of the usual JSON loggers.
_NUMBERS = {"FATAL": "0 1 2 50", "ERROR": "3 40 1000", "WARN": "4 30 900", "INFO": "5 6 20 800", "DEBUG": "7 10 300 400 500"}
_JSON_NUMBERS = {"FATAL": "0 1 2 60", "ERROR": "3 50", "WARN": "4 40", "INFO": "5 6 30", "DEBUG": "7 10 20"}

_COMBINED = r'^(\S+) [^\[]*\[(\d[^\]]+)\] "((?:[^"\\]|\\.)*+)" (\d{3}|-) (\d+|-)(?: "((?:[^"\\]|\\.)*+)" "((?:[^"\\]|\\.)*+)")?'
_SYSLOG = r"^<(\d{1,3})>([A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s\[:]+)(?:\[\d+\])?: ?(.*)$"
_SYSLOG_ISO = r"^<(\d{1,3})>\d+ (\S+) \S+ (\S+) \S+ \S+ ?(.*)$"
_SYSLOG_BARE = r"^([A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s\[:]+)(?:\[\d+\])?: ?(.*)$"
_GLOG = r"^([A-Z])(\d{2})(\d{2}) (\d{2}:\d{2}:\d{2}\.\d+) +\d+ ([^\]]+?):\d+\] ?(.*)$"
_BRACKET = r"^\[([^\]]+)\] ?\[([^\]]*)\](?: ?\[([^\]]*)\])? ?(.*)$"
_DASHED = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*) - (\S+) - (\S+) - ?(.*)$"
_COLUMNS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*) +\[?([^\s\]]+)\]? +\[?([^\s:\]]+)(?:[:\]]+|(?= )) ?(.*)$"
_SEP = "\u0001"
#: One key=value of a line of pairs, and one member of a JSON object; found one after the other, so that text inside quotes is never searched.
_PAIR = r'(?:^|\s)([\p{L}_@][\p{L}\p{N}_.@-]*)=("(?:[^"\\]|\\.)*+"|\S*)'
_MEMBER = r'"((?:[^"\\]|\\.)*+)"(?:\s*:\s*("(?:[^"\\]|\\.)*+"|[^\s,{}\[\]"]+))?'
#: Names of the fields in pairs and objects, lower case without separators, the likeliest first.
_NAMES = {
    "stamp": "ts timestamp time datetime eventtime loggedat at t when",
    "level": "level lvl severity loglevel sev priority",
    "component": "component comp logger module loggername source service app program prog name caller file",
    "client_ip": "clientip ip client remoteaddr remoteip srcip sourceip clientaddr clientaddress peer addr",
    "user_agent": "useragent ua agent",
    "message": "message msg text event",
}

_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = r"[0-9A-Fa-f]{1,4}"
_IPV6 = "|".join(
    [rf"(?:{_H}:){{7}}{_H}"]
    + [rf"(?:{_H}:){{1,{k}}}(?::{_H}){{1,{7 - k}}}" for k in range(1, 7)]
    + [rf"(?:{_H}:){{1,7}}:", rf":(?::{_H}){{1,7}}", "::", rf"(?:{_H}:){{6}}{_IPV4}"]
    + [rf"(?:{_H}:){{1,{k}}}(?::{_H}){{0,{5 - k}}}:{_IPV4}" for k in range(1, 6)]
    + [rf":(?::{_H}){{0,5}}:{_IPV4}"]
)


def valid_address(text: Column) -> Column:
    """Whether the text is an IPv4 or IPv6 address without a zone suffix; null for null."""
    return F.when(F.contains(text, F.lit(":")), text.rlike(rf"^(?:{_IPV6})$")).otherwise(text.rlike(rf"^{_IPV4}$"))


def level_name(word: Column, json: Column | None = None) -> Column:
    """DEBUG, INFO, WARN, ERROR or FATAL of a program's level word, letter or number; null if it is none.

    Numbers are syslog severities or the tens of Python's logging; where `json` holds, the tens of JSON loggers.
    """
    low = F.lower(word)
    out = F.lit(None).cast("string")
    for name, words in _LEVELS:
        numbers = low.isin(_NUMBERS[name].split())
        if json is not None:
            numbers = F.when(json, low.isin(_JSON_NUMBERS[name].split())).otherwise(numbers)
        out = F.when(low.isin(words.split()) | (low.rlike(r"^\d") & numbers), name).otherwise(out)
    return out


def signature(line: Column) -> Column:
    """The shape of a line: runs of letters as a, of digits as 9, of plain words as one, with its number of tabs and its ending."""
    flat = F.regexp_replace(F.regexp_replace(line, r"[\p{L}_]+", "a"), r"\d+", "9")
    words = F.regexp_replace(F.regexp_replace(flat, r" {2,}", " "), r"a(?: [a9])+(?=[ ,.;]|$)", "a")
    return F.concat_ws("~", words, F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit(""))), F.right(F.rtrim(line), F.lit(1)))


def resolve(signatures: DataFrame) -> DataFrame:
    """(sig, layout) of distinct signatures; shapes of no known layout get none."""
    layout = F.lit("none")
    for name, pattern in reversed(LAYOUTS):
        layout = F.when(F.col("sig").rlike(pattern), name).otherwise(layout)
    return signatures.select("sig", layout.alias("layout"))


def _named(keys: Column, values: Column) -> Column:
    """The known fields of a line's pairs or members as structs (name, i, value), each field's likeliest name first."""
    ranks = F.create_map(*[F.lit(x) for field, names in _NAMES.items() for k, n in enumerate(names.split()) for x in (n, f"{field}~{k:02}")])
    plain = F.transform(keys, lambda k: ranks[F.regexp_replace(F.lower(k), r"[-_. @]", "")])
    named = F.transform(F.arrays_zip(plain.alias("n"), values.alias("v")), lambda x, i: F.struct(x["n"].alias("name"), i.alias("i"), x["v"].alias("value")))
    return F.array_sort(F.filter(named, lambda x: x["name"].isNotNull()))


def _field(name: str) -> Column:
    """A field of _named; '' if the line has none."""
    value = F.coalesce(F.get(F.filter("_named", lambda x: x["name"].startswith(name + "~")), F.lit(0))["value"], F.lit(""))
    return F.regexp_replace(F.regexp_replace(value, r'^"|"$', ""), r'\\(["\\/])', "$1")


def _column(names: list[str]) -> Column:
    """The cell of a tab-separated line under the header in effect; null if the header names none of the columns."""
    cell = F.lit(None).cast("string")
    for n in reversed(names):
        at = F.array_position(F.col("_fields"), n)
        cell = F.when(at > 0, F.get(F.col("_cells"), (at - 1).cast("int"))).otherwise(cell)
    return F.when(cell != "-", cell)


def _by_layout(cases: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in cases.items():
        out = F.when(F.col("layout") == name, value).otherwise(out)
    return out


def _pack(values: list[Column]) -> Column:
    return F.concat_ws(_SEP, *[F.coalesce(v, F.lit("")) for v in values])


def _yearless(clock: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of a month and day without year in _md (`Jan 5` or `0105`): the year of the file's opening, or the next if that is half a year earlier."""
    opened = F.coalesce(F.col("opened_on"), F.to_date(F.col("received_at")))
    month = F.expr("IF(_md RLIKE '^[0-9]', left(_md, 2), lpad(CAST((locate(lower(left(_md, 3)), 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) div 3 AS STRING), 2, '0'))")
    day = F.expr("IF(_md RLIKE '^[0-9]', right(_md, 2), lpad(trim(right(_md, 2)), 2, '0'))")
    guess = F.concat_ws("-", F.year(opened).cast("string"), month, day)
    late = F.months_between(opened, guess.try_cast("date")) > 6
    return F.concat(F.when(late, (F.year(opened) + 1).cast("string")).otherwise(F.year(opened).cast("string")), F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock)


def parse_entries(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per log entry: log_file, first_line_no, last_line_no, entry_ms, log_level, component, message, client_ip, user_agent.

    `lines` has log_file, line_no, raw_line, received_at; `files` has log_file, zone_name, opened_on. Repeated
    deliveries of a line count once (the least text). Lines starting with #, null and empty lines, and lines that are
    neither an entry nor its continuation give nothing; an entry has a readable time. Times without a zone are in
    the file's zone, or UTC if it has none; a missing year comes from opened_on. Level, component, client_ip and
    user_agent are '' if the entry has none, client_ip also if it is no valid address. A message holds the entry's
    own line. Lines of tab-separated files with a `#Fields` header are UTC, as that format has it. Files that `files` lacks are read without zone and year hints. Extra columns are ignored.
    """
    base = lines.select("log_file", "line_no", "raw_line", "received_at").where("raw_line IS NOT NULL AND line_no IS NOT NULL").groupBy("log_file", "line_no").agg(F.min("raw_line").alias("raw_line"), F.min("received_at").alias("received_at"))
    base = materialize(base.withColumn("sig", signature(F.col("raw_line"))), "log-lines")
    rules = materialize(resolve(base.select("sig").distinct()), "log-shapes")
    base = base.join(F.broadcast(rules) if small(rules, 256) else rules, "sig").drop("sig")

    header = F.when((F.col("layout") == "comment") & F.col("raw_line").rlike(r"(?i)^#\s*fields:"), F.split(F.trim(F.regexp_replace(F.lower("raw_line"), r"^#\s*fields:", "")), r"\s+"))
    start = F.when(~F.col("layout").isin("comment", "none", "tabbed") | F.col("_header").isNotNull(), F.struct("line_no", "layout", F.col("_header").alias("fields")))
    # one pass carries both the header in effect and the entry above: a header is never an entry
    block = F.floor(F.col("line_no") / _BLOCK)
    tabbed = last_before(base.withColumn("_header", header), ["log_file"], ["line_no"], block, start, "_above", inclusive=False)
    own = ~F.col("layout").isin("comment", "none", "tabbed")
    above = F.col("_above")
    fields = above["fields"]
    row = tabbed.withColumn("_fields", fields).withColumn("_cells", F.when(F.col("layout") == "tabbed", F.split("raw_line", "\t")))
    row = row.withColumn("layout", F.when(F.col("layout") != "tabbed", F.col("layout")).when(F.size("_fields") == F.size("_cells"), "tabbed").otherwise("none"))
    follows = (F.col("layout") == "none") & (F.trim("raw_line") != "") & (
        above["layout"].isin(_MULTILINE) | ((above["layout"] == "object_start") & F.col("raw_line").rlike(r'^(?:\s+"|\s*[}\]])'))
    )
    first = F.when(follows, above["line_no"]).when(own | (F.col("layout") == "tabbed"), F.col("line_no"))
    row = row.withColumn("first_line_no", first).where(F.col("first_line_no").isNotNull()).withColumn("layout", F.when(follows & (above["layout"] == "object_start"), "member").when(follows, "more").otherwise(F.col("layout")))
    row = _with_files(row, files)

    # keys and values of lines of pairs and of objects, once a line
    json = F.col("layout").isin("object", "member")
    found = lambda group: F.when(json, F.regexp_extract_all("raw_line", F.lit(_MEMBER), F.lit(group))).when(F.col("layout") == "pairs", F.regexp_extract_all("raw_line", F.lit(_PAIR), F.lit(group)))
    row = row.withColumn("_named", _named(found(1), found(2)))

    # one packed text a line: stamp, level, component, address, agent, message, cut by the pattern of its rule
    cut_by = lambda pattern, template: F.regexp_replace("raw_line", pattern, _SEP.join(template))
    packed = _by_layout({
        "combined": cut_by(_COMBINED + ".*$", ["$2", "", "", "$1", "$7", "$3"]),
        "syslog": cut_by(_SYSLOG, ["@$2", "<$1", "$4", "", "", "$5"]),
        "syslog_iso": cut_by(_SYSLOG_ISO, ["$2", "<$1", "$3", "", "", "$4"]),
        "syslog_bare": cut_by(_SYSLOG_BARE, ["@$1", "", "$3", "", "", "$4"]),
        "glog": cut_by(_GLOG, ["@$2$3 $4", "$1", "$5", "", "", "$6"]),
        "bracket": cut_by(_BRACKET, ["$1", "$2", "$3", "", "", "$4"]),
        "dashed": cut_by(_DASHED, ["$1", "$2", "$3", "", "", "$4"]),
        "columns": cut_by(_COLUMNS, ["$1", "$2", "$3", "", "", "$4"]),
        "tabbed": _pack([F.concat_ws(" ", _column(["date"]), _column(["time"])), F.lit(""), F.lit(""), _column(["c-ip"]), F.replace(_column(["cs(user-agent)"]), F.lit("%20"), F.lit(" ")), F.concat_ws(" ", _column(["cs-method"]), _column(["cs-uri-stem"]))]),
    })
    packed = F.when(F.col("layout").isin("object", "member", "pairs"), _pack([_field(n) for n in _NAMES])).otherwise(packed)
    # the times of W3C extended files are UTC by their format, whatever the file's zone
    zone = F.when(F.col("layout") == "tabbed", "UTC").otherwise(F.coalesce("zone_name", F.lit("UTC")))
    cells = row.select("log_file", "first_line_no", "line_no", "received_at", "opened_on", "layout", zone.alias("zone_name"), F.split(packed, _SEP).alias("_c"))
    cells = cells.withColumn("_md", F.when(F.col("_c")[0].startswith("@"), F.regexp_extract(F.col("_c")[0], r"^@(\d{4}|[A-Za-z]+ +\d+)", 1)))
    stamp = F.when(F.col("_md").isNotNull(), _yearless(F.regexp_extract(F.col("_c")[0], r"(\S+)$", 1))).otherwise(F.col("_c")[0])
    severity = F.when(F.col("_c")[1].startswith("<"), F.pmod(F.regexp_extract(F.col("_c")[1], r"^<(\d+)", 1).try_cast("int"), F.lit(8)).cast("string"))
    # of two slots the one that holds a level is the level
    slots = F.col("layout").isin(_SLOTS)
    one, two = level_name(F.col("_c")[1]), level_name(F.col("_c")[2])
    swapped = slots & two.isNotNull() & (one.isNull() | (F.col("layout") == "dashed"))
    unnamed = slots & one.isNull() & two.isNull() & ((F.col("layout") == "dashed") | (F.col("_c")[2] == ""))
    level = F.when(swapped, two).otherwise(level_name(F.coalesce(severity, F.col("_c")[1]), F.col("layout").isin("object", "member")))
    part = F.when(swapped | unnamed, F.col("_c")[1]).otherwise(F.col("_c")[2])
    part = F.when(F.col("layout").isin("combined", "tabbed"), "").otherwise(F.regexp_replace(part, r"(?::\d+|\[\d+\]|\(\d+\))$", ""))
    names = {"client_ip": 3, "user_agent": 4, "message": 5}
    cut = cells.select("log_file", "first_line_no", "line_no", "zone_name", stamp.alias("stamp"), level.alias("log_level"), part.alias("component"), *[F.col("_c")[k].alias(n) for n, k in names.items()])
    timed = with_instant(cut, "stamp", "entry_ms", zone="zone_name")
    filled = lambda c: F.coalesce(F.max(F.when(F.col(c) != "", F.col(c))), F.lit("")).alias(c)
    entries = timed.groupBy("log_file", "first_line_no").agg(F.max("line_no").alias("last_line_no"), F.max("entry_ms").alias("entry_ms"), *[filled(c) for c in ("log_level", "component", "message", "client_ip", "user_agent")])
    return entries.where("entry_ms IS NOT NULL").withColumn("client_ip", F.when(valid_address(F.col("client_ip")), F.col("client_ip")).otherwise("")).withColumn("user_agent", F.when(F.col("user_agent") != "-", F.col("user_agent")).otherwise(""))


def _with_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Joins each file's zone and opening day; of repeated files the least."""
    hints = files.where("log_file IS NOT NULL").groupBy("log_file").agg(F.min("zone_name").alias("zone_name"), F.min("opened_on").alias("opened_on"))
    return rows.join(hints, "log_file", "left")


def found_form(entries: DataFrame) -> DataFrame:
    """parse_entries in the columns of a report: the time as UTC text, no message and agent."""
    return entries.select("log_file", "first_line_no", "last_line_no", utc_text(F.col("entry_ms")).alias("entry_utc"), "log_level", "component", "client_ip")
