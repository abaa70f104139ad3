"""Column builders over texts: clean-up, extraction, predicates and small formatters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
#: Words that look like part numbers but are none.
NOISE_WORDS = [
    "DC", "AC", "IC", "IF", "IO", "ID", "IN", "IT", "IS", "ON", "OR", "OF", "AN", "AS", "AT", "NO", "TO", "UP", "SO", "DO", "GO",
    "MIN", "MAX", "TYP", "NOTE", "REF", "PIN", "VCC", "VDD", "VSS", "GND", "OUT", "CLK", "EN", "RST",
]
PROTOCOLS = [
    "I2C", "SPI", "UART", "USART", "USB", "CAN", "LIN", "PCIE", "HDMI", "LVDS", "MIPI", "JTAG", "SWD", "DDR", "DDR2", "DDR3", "DDR4", "DDR5", "LPDDR4", "LPDDR5",
    "SDIO", "EMMC", "QSPI", "I2S", "TDM", "PWM", "ADC", "DAC", "ETHERNET", "RGMII", "SGMII", "MDIO", "RS232", "RS485", "RS422", "DISPLAYPORT", "DP", "DVI", "VGA", "GPIO", "SDRAM",
]
PACKAGES = ["QFP", "LQFP", "TQFP", "BGA", "QFN", "DFN", "SOIC", "SOP", "TSOP", "MSOP", "TSSOP", "SSOP", "DIP", "PDIP", "TO", "WLCSP", "CSP", "LGA"]
PART = r"\b([A-Z]{2,}[0-9]{2,}[A-Z0-9\-/]*|[A-Z][0-9]+[A-Z][0-9A-Z\-]*|[A-Z]{1,3}[0-9]{4,}[A-Z0-9\-]*)\b"
VOLTAGE = r"(?i)\b(\d+\.?\d*)\s*(V|mV|kV)\b"
CURRENT = r"(?i)\b(\d+\.?\d*)\s*(A|mA|µA|uA|nA)\b"
PROTOCOL = r"(?i)\b(" + "|".join(sorted(PROTOCOLS, key=lambda p: -len(p))) + r")\b"
PACKAGE = r"(?i)\b(SOT-?\d{2,3}[A-Z]*|" + "|".join(rf"{p}-?\d+" for p in PACKAGES) + r")\b"
COMPONENT = r"\b([URCLQD]\d{1,5})\b"
CHIP = r"\b(U\d{1,4})\b"
POWER_NET = r"(?i)\b([A-Z0-9*]*VCC[A-Z0-9_]*|[A-Z0-9_]*VDD[A-Z0-9_]*|GND|AGND|NRST)\b"
NAMED_NET = r"(?i)\b([A-Z][A-Z0-9]{0,15}_[A-Z0-9][A-Z0-9_]{0,31})\b"
DATA_NET = r"(?i)(?:^|[^A-Z0-9])([A-Z]{2,15})[_0]*D(\d+)(?:[^A-Z0-9]|$)"
CLEAN_PREFIX = r"(?i)\b([A-Z]{2,15})_"
MODULE_LABEL = r"^[A-Z][A-Z0-9 &/+-]{2,48}$"
NO_MODULES = ["TITLE", "AUTHOR", "DATE", "SIZE", "REVISION", "FILE", "VERSION", "GND", "VCC", "AGND", "PHONE", "LINE_IN", "SHEETSIZE", "BOOT0", "RESET"]
FOLLOW_UPS = ["它", "这个", "那个", "该", "上面", "前面", "刚才", "this", "that", "it", "its", "the same", "above", "继续", "展开", "详细", "更多"]
REFUSALS = ["知识库中未找到", "知识库缺乏", "insufficient knowledge", "insufficient context", "无法回答", "未找到相关内容", "未找到相关"]
TASKS = ["design_review", "translate", "debug", "wiki", "fa"]
AUXILIARY = [
    "generate a concise, 3-5 word title", "generate 1-3 broad tags", "suggest 3-5 relevant follow-up", "generate a detailed prompt for am image generation",
    "generate a detailed prompt for an image generation", "generate 3-5 relevant search queries", "generate search queries", "autocomplete the user's message", "mixture-of-agents", "voice mode",
]
STOP_TOKENS = ["的", "有", "哪", "几", "组", "是", "在", "和", "与", "及", "pin", "pins", "signal", "signals", "哪些", "什么"]
PIN_WORDS = "(?i)(?:pin|pins|引脚|脚)"
INTERFACE_WORDS = "(?i)(?:lcd|display|touchscreen|touch|触摸屏|接口|interface|connector|header|排针|屏幕|rmii|i2s|uart|spi|i2c|eth|usb)"
LCD_NETS = ["T_CS", "T_MOSI", "T_MISO", "T_SCK", "T_PEN", "LCD_BL", "PITFTLC"]
CJK = "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
CJK_BASIC = "\\x{4E00}-\\x{9FFF}"
# ------------------------------------------------------------------------------------------------

#: Letters, digits, underscore and ampersand; runs of other scripts stay whole.
TOKEN = r"[\p{L}\p{N}_&]+"
STRINGS = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(STRINGS)


def strip(text: Column) -> Column:
    """All white space off both ends, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def slug(text: Column, joint: str = "-", fallback: str = "") -> Column:
    """Lower case; runs of what is no letter, digit, underscore or hyphen become ``joint``."""
    made = F.regexp_replace(F.lower(strip(text)), r"(?U)[^\w\-]+", joint)
    made = F.regexp_replace(made, f"^{joint}+|{joint}+$", "")
    return F.when(made == "", fallback).otherwise(made) if fallback else made


def filename_slug(stem: Column) -> Column:
    made = F.regexp_replace(F.replace(F.lower(stem), F.lit(" "), F.lit("_")), r"(?U)[^\w\-]+", "_")
    made = F.regexp_replace(made, "^_+|_+$", "")
    return F.when(made == "", "document").otherwise(made)


def plain_markdown(text: Column) -> Column:
    """Line feeds only, and exactly one at the end."""
    return F.concat(rstrip(F.regexp_replace(text, r"\r\n?", "\n")), F.lit("\n"))


def page_text(text: Column) -> Column:
    """Lines without trailing blanks, at most one empty line in a row, nothing at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n"))


def cjk_ratio(text: Column) -> Column:
    script = F.length(F.regexp_replace(text, rf"[^\p{{L}}{CJK}]", ""))
    return F.when(script == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / script)


def ocr_language(text: Column, threshold: float = 0.05) -> Column:
    return F.when(cjk_ratio(text) >= threshold, "eng+chi_sim").otherwise("eng")


def script_language(script: Column) -> Column:
    """A detected script as OCR languages; what is unknown gets both."""
    return F.when(F.lower(script).isin("latin"), "eng").otherwise("eng+chi_sim")


def page_kind(text_chars: Column, lines: Column, image_ratio: Column) -> Column:
    return (F.when(lines >= 50, "TABLE").when((image_ratio >= 0.6) & (text_chars < 200), "GRAPH")
            .when((text_chars >= 500) & (lines < 20), "TEXT").otherwise("MIXED"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def keywords(text: Column, cap: int = 50) -> Column:
    """Part numbers, voltages, currents, protocols and packages: longest first, then by text."""
    def pairs(pattern: str, unit) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(whole, lambda m: F.concat(F.regexp_extract(m, pattern, 1), unit(F.regexp_extract(m, pattern, 2))))

    parts = F.filter(F.regexp_extract_all(text, F.lit(PART), F.lit(1)), lambda p: F.length(p) >= 4)
    found = F.array_union(parts, pairs(VOLTAGE, F.upper))
    found = F.array_union(found, pairs(CURRENT, lambda u: F.replace(u, F.lit("µ"), F.lit("u"))))
    for pattern in (PROTOCOL, PACKAGE):
        found = F.array_union(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper))
    found = F.array_except(found, strings(NOISE_WORDS))
    ranked = F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.slice(F.transform(ranked, lambda s: s["k"]), 1, cap)


def merged_keywords(existing: Column, extracted: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(existing, F.array().cast(STRINGS)), extracted))


def single_underscores(text: Column) -> Column:
    return F.regexp_replace(text, r"\b([A-Z][A-Z0-9]{1,15})__", "$1_")


def known_prefixes(text: Column) -> Column:
    clean = F.transform(F.regexp_extract_all(text, F.lit(CLEAN_PREFIX), F.lit(1)), F.upper)
    named = F.transform(F.regexp_extract_all(text, F.lit(NAMED_NET), F.lit(1)), lambda n: F.upper(F.substring_index(n, "_", 1)))
    return F.array_union(clean, named)


def recovered_nets(text: Column, most: int = 15) -> Column:
    """``PREFIX_Dn`` nets inside noise: the shortest known suffix of the prefix, n up to ``most``."""
    return let(single_underscores(text), lambda clean: _recovered(clean, most))


def _recovered(clean: Column, most: int = 15) -> Column:
    def net(match: Column, known: Column) -> Column:
        def named(raw: Column) -> Column:
            suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.length(raw), F.lit(2))), lambda n: F.right(raw, n))
            fit = F.filter(suffixes, lambda s: F.array_contains(known, s) & (F.length(s) >= 2))
            return F.coalesce(F.get(fit, 0), raw)

        return F.concat(let(F.upper(F.regexp_extract(match, DATA_NET, 1)), named), F.lit("_D"), F.regexp_extract(match, DATA_NET, 2).cast("int").cast("string"))

    matches = F.regexp_extract_all(clean, F.lit(DATA_NET), F.lit(0))
    digits = F.transform(matches, lambda m: F.struct(m.alias("m"), F.regexp_extract(m, DATA_NET, 2).alias("i")))
    fit = F.filter(digits, lambda x: (F.length(x["i"]) <= 9) & (x["i"].try_cast("int") <= most))
    return let(known_prefixes(clean), lambda known: F.array_distinct(F.transform(fit, lambda x: net(x["m"], known))))


def nets(text: Column) -> Column:
    def found(clean: Column) -> Column:
        own = F.array_union(F.regexp_extract_all(clean, F.lit(NAMED_NET), F.lit(1)), F.regexp_extract_all(clean, F.lit(POWER_NET), F.lit(1)))
        return F.filter(F.array_union(own, _recovered(clean)), lambda n: ~F.rlike(n, F.lit(r"^[URCLQD]\d{1,5}$")))

    return by_upper(let(single_underscores(text), found))


def by_upper(values: Column) -> Column:
    return F.transform(F.sort_array(F.transform(values, lambda n: F.struct(F.upper(n).alias("u"), n.alias("n")))), lambda s: s["n"])


def components(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(COMPONENT), F.lit(1)))


def major_components(text: Column) -> Column:
    chips = F.filter(components(text), lambda c: F.startswith(c, F.lit("U")))
    return let(chips, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(CHIP), F.lit(1)))))


def module_labels(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip)
    zone = lambda x: F.contains(x, F.lit("&")) | F.contains(x, F.lit("/")) | (F.contains(x, F.lit(" ")) & (F.length(x) >= 8))
    fit = lambda x: (F.length(x) <= 48) & F.rlike(x, F.lit(MODULE_LABEL)) & ~F.upper(x).isin(NO_MODULES) & zone(x)
    return F.array_distinct(F.filter(lines, fit))


def interfaces(text: Column) -> Column:
    named = F.transform(F.filter(nets(text), lambda n: F.contains(n, F.lit("_"))), lambda n: F.substring_index(n, "_", 1))
    return ordered_distinct(F.concat(module_labels(text), named))


def ordered_distinct(values: Column) -> Column:
    """Stripped, without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def module_region(label: Column, text: Column, labels: Column, window: int = 3000) -> Column:
    """``text`` from ``label`` to the next other label, at most ``window`` characters; all upper case."""

    def region(x: Column) -> Column:
        upper, own, at = x["upper"], x["own"], x["at"]
        others = F.filter(F.transform(labels, F.upper), lambda o: o != own)
        starts = F.filter(F.transform(others, lambda o: F.position(o, upper, at + F.length(own))), lambda p: p > at)
        end = F.least(F.length(upper) + 1, at + window, F.coalesce(F.array_min(starts), F.lit(2**31 - 1)))
        return F.when(at == 0, "").otherwise(F.substring(upper, at, end - at))

    told = let(F.struct(F.upper(text).alias("upper"), F.upper(label).alias("own")), lambda x: F.struct(x["upper"].alias("upper"), x["own"].alias("own"), F.position(x["own"], x["upper"]).alias("at")))
    return let(told, region)


def nets_in_region(label: Column, region: Column, found: Column) -> Column:
    """Nets in a label's region, or whose prefix is a word of the label."""
    words = F.filter(F.split(F.upper(label), r"[&/\s]+"), lambda w: F.length(w) >= 2)
    own = let(words, lambda w: F.filter(found, lambda n: F.contains(region, F.upper(n)) | F.array_contains(w, F.upper(F.substring_index(n, "_", 1)))))
    return by_upper(F.array_distinct(own))


def module_zones(labels: Column, found: Column, text: Column) -> Column:
    """Array of (label, nets).  Regions come first, so that each is found once and not once a net."""
    regions = F.transform(labels, lambda x: F.struct(x.alias("label"), module_region(x, text, labels).alias("region")))
    return F.transform(regions, lambda z: F.struct(z["label"].alias("label"), nets_in_region(z["label"], z["region"], found).alias("nets")))


def power_nets(found: Column) -> Column:
    named = ["GND", "AGND", "VCC", "VDD", "VCC3.3", "VCC3V3", "VCC5"]
    return by_upper(F.array_distinct(F.filter(found, lambda n: F.upper(n).isin(named) | F.startswith(F.upper(n), F.lit("VCC")) | F.startswith(F.upper(n), F.lit("VDD")))))


def token_estimate(text: Column) -> Column:
    cjk = F.length(F.regexp_replace(text, f"[^{CJK_BASIC}]", ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), (cjk / 1.2 + (F.length(text) - cjk) / 4).cast("int")))


def needs_rewrite(question: Column, has_prior_user: Column) -> Column:
    short = (F.length(question) < 60) & any_of(F.lower(question), FOLLOW_UPS)
    return has_prior_user & (short | (F.length(question) < 20))


def needs_history(question: Column, has_history: Column, has_prior_user: Column, task: Column, retrieval_query: Column) -> Column:
    rewritten = F.coalesce(strip(retrieval_query) != strip(question), F.lit(False))
    return has_history & (F.coalesce(task == "translate", F.lit(False)) | rewritten | needs_rewrite(question, has_prior_user))


def task_label(raw: Column) -> Column:
    """A task name out of a model's reply: exact, else the first (in a fixed order) it contains."""
    line = strip(F.split_part(strip(raw), F.lit("\n"), F.lit(1)))
    line = F.lower(strip(F.regexp_replace(F.regexp_replace(line, "^[\"'`\\s]+|[\"'`\\s]+$", ""), "[.。,，;；:：!！?？]", "")))
    found = F.when(line.isin(TASKS), line)
    for task in TASKS:
        found = found.when(F.contains(line, F.lit(task)), task)
    return found


def labelled_line(raw: Column, label: str) -> Column:
    """What follows ``LABEL:`` on its line, or null."""
    found = F.regexp_extract(raw, rf"(?im)^{label}:\s*(.+)$", 1)
    return F.when(F.rlike(raw, F.lit(rf"(?im)^{label}:\s*(.+)$")), found)


def optional_field(raw: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(strip(raw), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when((value != "") & ~F.lower(value).isin("none", "null", "n/a"), value)


def retrieval_query(raw: Column, question: Column) -> Column:
    """The QUERY line of a model's reply unless it is empty or suspiciously long."""
    found = F.regexp_replace(F.regexp_replace(strip(labelled_line(raw, "QUERY")), '^"+|"+$', ""), "^'+|'+$", "")
    fit = (found != "") & (F.length(found) <= F.greatest(F.length(question) * 5, F.lit(256)))
    return F.when(F.coalesce(fit, F.lit(False)), found).otherwise(question)


def image_refs(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    found = F.transform(found, lambda r: F.regexp_replace(F.regexp_replace(strip(r), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.filter(found, lambda r: (r != "") & ~F.startswith(r, F.lit("#")))


def section_fragment(chunk_id: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(chunk_id, r"(?s)^.*?__(.*)$", 1), r"__w\d+$", "")
    return F.when(base == "", "").otherwise(F.concat(F.lit("#"), base))


def section_key(chunk_id: Column) -> Column:
    return F.regexp_replace(chunk_id, r"__w\d+$", "")


def quoted_path(path: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_url(base: str, path: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/v1/sources/"), quoted_path(path), section_fragment(chunk_id))


def asset_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(f"{base}/v1/assets/"), quoted_path(F.regexp_replace(path, "^/+", "")))


def page_image(target_file: Column, page: Column) -> Column:
    """Where the render of a page lies, or null."""
    name = filename_slug(F.regexp_replace(F.element_at(F.split(target_file, "/"), -1), r"\.[^.]*$", ""))
    folder = F.regexp_replace(target_file, r"[^/]*$", "")
    path = F.concat(folder, F.lit("images/"), name, F.lit("/"), name, F.lit("_p"), page.cast("string"), F.lit("_page.png"))
    return F.when((target_file != "") & (page > 0), path)


def asset_path(folder: Column, ref: Column) -> Column:
    """A reference inside ``folder``, or null if it leaves the mirror: '.' goes, '..' takes a step up."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(ref, "/")), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast(STRINGS).alias("kept"), F.lit(True).alias("inside"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(~up, F.concat(acc["kept"], F.array(part))).when(F.size(acc["kept"]) > 0, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), (acc["inside"] & ~(up & (F.size(acc["kept"]) == 0))).alias("inside"))

    walked = F.aggregate(parts, start, step)
    return F.when(F.startswith(ref, F.lit("http://")) | F.startswith(ref, F.lit("https://")), ref).when((strip(ref) != "") & ~F.startswith(ref, F.lit("#")) & walked["inside"], F.array_join(walked["kept"], "/"))


def elapsed(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    return F.when(s < 60, F.format_string("%.1f 秒", s)).otherwise(F.format_string("%d 分 %.1f 秒", F.floor(s / 60), s - F.floor(s / 60) * 60))


def phase_footer(retrieval: Column, generation: Column, first: Column) -> Column:
    return F.concat(F.lit("\n\n---\n⏱ 检索 "), elapsed(retrieval), F.lit(" · 生成 "), elapsed(generation), F.lit(" · 首字 "), elapsed(first))


def pieces(text: Column, size: int = 200) -> Column:
    """Fixed-length pieces of a text."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count == 0, F.array().cast(STRINGS)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def is_auxiliary(text: Column) -> Column:
    low = F.lower(strip(text))
    history = F.contains(low, F.lit("<chat_history>")) | F.contains(low, F.lit("### chat history:"))
    return F.startswith(strip(text), F.lit("### Task:")) & history & any_of(low, AUXILIARY)


def normal_path(path: Column) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    out = clean
    for marker in ("data/raw/", "data/processed/"):
        out = F.when(F.contains(clean, F.lit(marker)), F.substring(clean, F.locate(marker, clean), F.length(clean))).otherwise(out)
    return out


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def path_matches(required: Column, candidate: Column) -> Column:
    a, b = normal_path(required), normal_path(candidate)
    return (a == b) | ((stem(a) == stem(b)) & (parent(a) == parent(b)))


def fact_in(fact: Column, text: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(fact), r"\s+", "")
    return (squeezed != "") & (F.contains(F.regexp_replace(F.lower(text), r"\s+", ""), squeezed) | F.contains(F.lower(text), F.lower(fact)))


def preview(text: Column, size: int = 240) -> Column:
    compact = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(compact) <= size, compact).otherwise(F.concat(F.substring(compact, 1, size - 3), F.lit("...")))


def is_refusal(answer: Column, insufficient: Column) -> Column:
    return insufficient | any_of(F.lower(answer), REFUSALS)


def excerpt(text: Column, size: int = 200) -> Column:
    own = strip(text)
    return F.when(F.length(own) <= size, own).otherwise(F.concat(rstrip(F.substring(own, 1, size)), F.lit("…")))


def index_text(heading_path: Column, content: Column) -> Column:
    return F.when(heading_path != "", F.concat(heading_path, F.lit("\n\n"), content)).otherwise(content)


def heading_path(parts: Column) -> Column:
    """Non-empty labels joined, consecutive repeats once."""
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.array_join(F.filter(kept, lambda p, i: (i == 0) | (p != F.get(kept, i - 1))), " › ")


def without_rules(text: Column) -> Column:
    """Lines that are only ``---`` go."""
    return strip(F.array_join(F.filter(F.split(text, "\n"), lambda line: strip(line) != "---"), "\n"))


def boost_tokens(query: Column) -> Column:
    """Query words that should rank literal matches higher, each once ignoring case."""
    found = F.filter(tokens(query), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(STOP_TOKENS))
    start = F.struct(F.array().cast(STRINGS).alias("kept"), F.array().cast(STRINGS).alias("lows"))

    def step(acc: Column, t: Column) -> Column:
        low = F.lower(t)
        more = F.struct(F.array_append(acc["kept"], t).alias("kept"), F.array_append(acc["lows"], low).alias("lows"))
        return F.when(F.array_contains(acc["lows"], low), acc).otherwise(more)

    # A fold, because Spark may leave a Python function unplanned when in its arguments a lambda uses a variable
    # of an outer one, as with ``let``.
    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def is_pin_query(query: Column) -> Column:
    return F.rlike(query, F.lit(PIN_WORDS)) & F.rlike(query, F.lit(INTERFACE_WORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once; a lambda would work out what it captures for every
    element.  Not for arguments of Python functions: see ``boost_tokens``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hits_in(words: Column, text: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    return let(upper(text), lambda told: F.size(F.filter(words, lambda t: F.contains(told, upper(t)))))


@cache
def case_letters(upper: bool) -> tuple[str, str]:
    """Letters that have one other letter in upper (or lower) case, as SQL has it, and those others."""
    told = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):  # none follow
        # Some have an upper case of several letters, but a title of one.
        ways = ("ẞ" if c == "ß" else c.upper(), c.title()) if upper else ("i" if c == "İ" else c.lower(),)
        other = next((x for x in ways if len(x) == 1), c)
        if other != c:
            told[c] = other
    return "".join(told), "".join(told.values())


def upper_by_letter(text: Column) -> Column:
    """``text`` in upper case letter by letter, as SQL has it; ``upper`` writes some as two, as ``ß`` as ``SS``."""
    return F.translate(text, *case_letters(True))


def lower_by_letter(text: Column) -> Column:
    """``text`` in lower case letter by letter, as SQL has it, whatever stands around a letter."""
    return F.translate(text, *case_letters(False))


def boost_tokens_by_letter(query: Column) -> Column:
    """``boost_tokens`` in lower case, with the case of SQL."""
    found = F.array_distinct(F.transform(tokens(query), lower_by_letter))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_TOKENS))


def first_heading(text: Column) -> Column:
    """The first non-blank line, stripped."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 0), F.lit(""))


def heading_level(text: Column) -> Column:
    return F.length(F.regexp_extract(first_heading(text), r"^(#+)\s+", 1))


def section_heading(text: Column) -> Column:
    return strip(F.regexp_extract(first_heading(text), r"^#{1,2}\s+(.+)$", 1))

