"""The listing queries in SQL, written independently of the column expressions they check."""

from __future__ import annotations

from garimpo.functions.edges import ODD_SPACES
from garimpo.functions.relevance import WEIGHTS, query_tokens
from garimpo.functions.titles import BRANDS, OUT_OF_STOCK
from garimpo.sources.listings import LISTINGS_SQL


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


L = "(" + LISTINGS_SQL.replace("{part}", "part") + ")"
RAW = "(SELECT DISTINCT * FROM raw_products)"


def plain(x: str) -> str:
    return f"translate({x}, '{ODD_SPACES}', '{' ' * len(ODD_SPACES)}')"


def first(x: str, pattern: str, group: int = 1, options: str = "") -> str:
    return f"nullif(regexp_extract({x}, {_quote(pattern)}, {group}, '{options}'), '')"


def clean(x: str) -> str:
    y = plain(f"coalesce({x}, '')")
    for pattern, to, options in (
        ("[*★⭐]+​?", "", "g"), (r"avaliação\s*[\d.,]+\s*de\s*[\d.,]*", "", "gi"), (r"^selo:\s*\S+(?:\s+\S+)?\s*", "", "i"), (r"^produto\s+patrocinado\s*", "", "i"),
        (r"\s*\d+\s*[x×]\s*de\s*r\$\s*[\d.,]+\s*", " ", "gi"), (r"\s*\(\d+[^)]*\s*[Gg]eração\)", "", ""), (r"\s+", " ", "g"),
    ):
        y = f"regexp_replace({y}, {_quote(pattern)}, '{to}'" + (f", '{options}')" if options else ")")
    return f"trim({y})"


def brand(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\bnvidia\\b', 'i') THEN 'NVIDIA' ELSE {first(x, '\\b(' + '|'.join(BRANDS) + ')\\b', 1, 'i')} END"


def storage_capacity(x: str) -> str:
    return f"trim(coalesce({first(x, r'\b(\d+\.\d+\s*TB)\b', 1, 'i')}, {first(x, r'\b(\d+(?:\.\d+)?\s*TB)\b', 1, 'i')}, {first(x, r'\b(\d+(?:\.\d+)?\s*GB)\b', 1, 'i')}))"


def memory_capacity(x: str) -> str:
    words = " OR ".join(f"contains(lower({x}), '{w}')" for w in ("ram", "dimm", "ddr", "memória"))
    return f"CASE WHEN {words} OR regexp_matches({x}, '\\b\\d+(?:\\.\\d+)?\\s*GB', 'i') THEN trim({first(x, r'\b(\d+(?:\.\d+)?\s*(?:GB|MB))\b', 1, 'i')}) END"


def availability(title: str, text: str, provider: str) -> str:
    all_ = f"lower({title} || ' ' || coalesce({text}, ''))"
    gone = " OR ".join(f"contains({all_}, '{p}')" for p in OUT_OF_STOCK)
    return (
        f"CASE WHEN coalesce({title}, '') = '' THEN 'unknown' WHEN {gone} THEN 'out_of_stock' WHEN regexp_matches({text}, '[0-9]') THEN 'in_stock' "
        f"WHEN {provider} = 'kabum' THEN CASE WHEN coalesce({text}, '') <> '' THEN 'in_stock' ELSE 'unknown' END ELSE 'in_stock' END"
    )


def number(x: str) -> str:
    y = f"regexp_replace({x}, '\\s+', '', 'g')"
    z = f"CASE WHEN contains({y}, ',') THEN regexp_replace(replace({y}, '.', ''), ',', '.') WHEN regexp_matches({y}, '^\\d{{1,3}}(?:\\.\\d{{3}})+$') THEN replace({y}, '.', '') ELSE regexp_replace({y}, '[^\\d.]', '', 'g') END"
    return f"CASE WHEN regexp_matches({z}, '^(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast({z} AS DOUBLE) END"


def parse_price(x: str) -> str:
    t = plain(x)
    parts = f"string_split_regex({t}, '(?i)r\\$')"
    value = "regexp_extract(ps[i + 1], '^\\s*([\\d\\s.,]+)', 1)"
    ok = "NOT regexp_matches(right(ps[i], 12), '(?i)\\d\\s*[x×]\\s*(?:de\\s*)?$') AND NOT regexp_matches(ps[i + 1], '(?i)^\\s*[\\d\\s.,]+[x×]')"
    prefixed = f"(SELECT min(v) FROM (SELECT unnest([CASE WHEN {ok} THEN {number(value)} END FOR i IN range(1, len(ps))]) AS v FROM (SELECT {parts} AS ps)) WHERE v > 0)"
    loose = f"regexp_replace(regexp_replace({t}, '(\\d\\s*[x×]\\s*(?:de\\s*)?)\\d[\\d.,\\s]*', '\\1', 'gi'), '\\d[\\d.,\\s]*([x×])', '\\1', 'gi')"
    other = f"(SELECT max(v) FROM (SELECT unnest([{number('n')} FOR n IN regexp_extract_all({loose}, '\\d[\\d.,\\s]*')]) AS v) WHERE v > 0)"
    return f"CASE WHEN coalesce({x}, '') <> '' THEN coalesce({prefixed}, {other}) END"


def stored_price(x: str) -> str:
    y = f"regexp_replace(replace(regexp_replace({x}, '[^\\d.,]', '', 'g'), '.', ''), ',', '.')"
    return f"coalesce(try_cast(nullif(regexp_extract({y}, '^(\\d+\\.?\\d*|\\.\\d+)', 1), '') AS DOUBLE), 0)"


def original_price(now: str, x: str) -> str:
    found = f"regexp_extract_all({plain(x)}, 'r\\$\\s*([\\d.]+,\\d{{2}}|\\d+(?:\\.\\d+)?)', 1, 'i')"
    vs = f"(SELECT [v FOR v IN [try_cast(replace(replace(a, '.', ''), ',', '.') AS DOUBLE) FOR a IN {found}] IF v > 0])"
    return f"CASE WHEN {now} IS NOT NULL AND len({vs}) > 1 THEN greatest(list_max({vs}), {now}) ELSE {now} END"


def model(source: str, key: str) -> str:
    """The model of each row of a relation (key, title)."""
    return f"""
    SELECT {key}, CASE WHEN clean <> '' THEN coalesce(
        CASE WHEN b IS NULL OR lower(m1) <> fw THEN m1 END, CASE WHEN b IS NULL OR lower(m2) <> fw THEN m2 END, CASE WHEN b IS NULL OR lower(m3) <> fw THEN m3 END,
        CASE WHEN b IS NULL OR lower(m4) <> fw THEN m4 END, CASE WHEN length(rest) > 0 AND length(rest) < 60 THEN rest END,
        list_filter(regexp_split_to_array(clean, '\\s+'), lambda t: length(t) >= 2 AND regexp_matches(t, '\\d'))[1], clean) END AS model
    FROM (SELECT *, lower(string_split(b, ' ')[1]) AS fw, CASE WHEN strpos(clean, b) > 0 THEN trim(substring(clean, strpos(clean, b) + length(b))) END AS rest,
            trim({first("clean", r"\b(GeForce\s+(?:RTX|GTX)\s*\d+(?:\s*Ti)?(?:\s+\w+)?)", 1, "i")}) AS m1, trim({first("clean", r"\b(Ryzen\s+(?:\d+\s*\S+|9\s+\d+\S*))", 1, "i")}) AS m2,
            trim({first("clean", r"\b(Core\s+(?:i\d|3|5|7|9)[\s.\d\-IX]+)", 1, "i")}) AS m3, trim({first("clean", r"\b([A-Z]\d{2,4}[A-Z]?)")}) AS m4
          FROM (SELECT {key}, {clean("title")} AS clean, {brand("title")} AS b FROM ({source}) l) x) y"""


_MODEL = model(f"SELECT listing_id, title FROM {L} l", "listing_id")
PRODUCTS = "SELECT id, originaltitle AS title, provider, pricetext, currency, url FROM normalized_products"


def canonical(source: str) -> str:
    """Facts of each row of a relation (id, title)."""
    brands = (("samsung", "SAMSUNG"), ("kingston", "KINGSTON"), ("crucial", "CRUCIAL"), ("wd", "WD"), ("western digital", "WD"), ("corsair", "CORSAIR"), ("lexar", "LEXAR"), ("xpg", "XPG"), ("intel", "INTEL"), ("amd", "AMD"), ("nvidia", "NVIDIA"), ("seagate", "SEAGATE"), ("transcend", "TRANSCEND"), ("sandisk", "SANDISK"), ("kingspec", "KINGSPEC"))
    case = " ".join(f"WHEN regexp_matches(title, '\\b{n}\\b', 'i') THEN '{v}'" for n, v in brands)
    m = [first("title", p, 1, o) for p, o in ((r"(\d{3,4})\s+(?:EVO|PRO|PLUS|TFT|ITL|QVO)", "i"), (r"(\d{3,4})\s+(?:Green|Blue|Black)\b", "i"), (r"([A-Z]{2}\d{2,4})\b", "i"), (r"([A-Z]\d{2,4})\b", "i"), (r"\b(NV\d+)\b", "i"), (r"(\d{3,4})\b", ""))]
    f1, f2 = first("title", r"\d{3,4}\s+(EVO|PRO|PLUS|TFT|ITL|QVO)", 1, "i"), first("title", r"\d{3,4}\s+(Green|Blue|Black)\b", 1, "i")
    return f"""
    SELECT *, CASE WHEN interface = 'NVMe' THEN 'NVMe' WHEN interface = 'SATA' THEN 'SATA' WHEN interface IS NOT NULL THEN CASE WHEN regexp_matches(title, '\\bNV[Mm]e?\\b', 'i') THEN 'NVMe' ELSE 'SATA' END END AS protocol,
           coalesce(s1, s2, s3, CASE WHEN regexp_matches(title, '\\b(A\\d{{3}}|M[XP]\\d{{3}})\\b', 'i') THEN family END) AS manufacturerSku
    FROM (SELECT *, coalesce(m1, m2, m3, m4, m5, m6) AS model,
            CASE WHEN m1 IS NOT NULL THEN upper({f1}) WHEN m2 IS NOT NULL THEN upper({f2}) WHEN coalesce(m3, m4, m5) IS NOT NULL THEN upper(coalesce(m3, m4, m5)) WHEN m6 IN ('870', '980', '990', '840') THEN m6 END AS family,
            CAST(coalesce(floor(CAST(tb AS DOUBLE) * 1000 + 0.5::DOUBLE), floor(CAST(gb AS DOUBLE) + 0.5::DOUBLE), CAST(g AS DOUBLE)) AS INT) AS capacityGB, CAST(tb AS DOUBLE) AS capacityTB
          FROM (SELECT *, CASE {case} END AS brand, {m[0]} AS m1, {m[1]} AS m2, {m[2]} AS m3, {m[3]} AS m4, {m[4]} AS m5, {m[5]} AS m6,
                  {first("title", r"\b(\d+\.?\d*)\s*TB\b", 1, "i")} AS tb, {first("title", r"\b(\d+\.?\d*)\s*GB\b", 1, "i")} AS gb, {first("title", r"\b(\d{3,4})G\b", 1, "i")} AS g,
                  CASE WHEN regexp_matches(title, '\\b2280\\b|\\bM\\.2\\b|\\bM2\\b', 'i') THEN 'M.2' WHEN regexp_matches(title, '\\bNV[Mm]e?\\b') THEN 'NVMe' WHEN regexp_matches(title, '\\bPCI[-\\s]?[Ee](?:2|3|4|5)?\\b') THEN 'PCIe' WHEN regexp_matches(title, '\\bSATA', 'i') THEN 'SATA' END AS interface,
                  CASE WHEN regexp_matches(title, '\\bGen[ _]?5\\b|\\bPCIe[ _]?5\\b', 'i') THEN 5 WHEN regexp_matches(title, '\\bGen[ _]?4\\b|\\bPCIe[ _]?4\\b', 'i') THEN 4 WHEN regexp_matches(title, '\\bGen[ _]?3\\b|\\bPCIe[ _]?3\\b', 'i') THEN 3 END AS pcieGeneration,
                  CASE WHEN regexp_matches(title, '\\bM\\.[2-4][0-6]\\b|\\bM\\.2\\b', 'i') THEN 'M.2' WHEN regexp_matches(title, '\\b2\\.5["'']?\\b') THEN '2.5"' END AS formFactor,
                  {first("title", r"\b([A-Z]{2,4}\d{2,4}[A-Z]\d{2}/\d+[A-Z])\b")} AS s1, upper({first("title", r"\b(WD[SBE]\d{3,4}T\dG\d[A-Z]+)\b", 1, "i")}) AS s2, {first("title", r"\b([A-Z]{2}\d{3,5}[A-Z]{2,4})\b")} AS s3
                FROM ({source}) src) a) b"""


_CANON = canonical(f"SELECT listing_id, provider, title, price_text FROM {L} l")
_CONFIDENCE = """
      CASE WHEN brand IS NULL THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS conf_brand, CASE WHEN model IS NULL THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END AS conf_model,
      CASE WHEN coalesce(tb, gb) IS NOT NULL THEN 0.95::DOUBLE WHEN g IS NOT NULL THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS "conf_capacityGB",
      CASE interface WHEN 'M.2' THEN 0.8::DOUBLE WHEN 'NVMe' THEN 0.95::DOUBLE WHEN 'SATA' THEN 0.95::DOUBLE WHEN 'PCIe' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS conf_interface,
      CASE WHEN interface IN ('NVMe', 'SATA') THEN 0.95::DOUBLE WHEN interface IS NOT NULL THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS conf_protocol,
      CASE WHEN pcieGeneration IS NULL THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS "conf_pcieGeneration", CASE WHEN formFactor IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS "conf_formFactor",
      CASE WHEN s1 IS NOT NULL THEN 0.95::DOUBLE WHEN s2 IS NOT NULL THEN 0.9::DOUBLE WHEN s3 IS NOT NULL THEN 0.85::DOUBLE WHEN manufacturerSku IS NOT NULL THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS "conf_manufacturerSku" """
_SURE = f"""
    SELECT *, floor((conf_brand + conf_model + "conf_capacityGB" + conf_interface + conf_protocol + "conf_pcieGeneration" + "conf_formFactor" + "conf_manufacturerSku") / 8::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS conf_overall
    FROM (SELECT *, {_CONFIDENCE} FROM ({_CANON}) c) d"""

INPUTS = ("brand", "model", "family", "manufacturerSku", "capacityGB", "interface", "protocol", "pcieGeneration", "formFactor")


def _alias(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {x} END"


def norm(x: str, keep: str = "A-Z0-9", to: str = " ") -> str:
    return f"trim(regexp_replace(upper({x}), '[^{keep}]+', '{to}', 'g'))"


_B = lambda s: _alias(norm(f"{s}_brand"), {"WESTERN DIGITAL": "WD", "WDC": "WD", "WD BLUE": "WD", "WD BLACK": "WD"})
_S = lambda s: norm(f"{s}_manufacturerSku", to="")
_I = lambda s, c: _alias(norm(f"{s}_{c}", "A-Z0-9."), {"M2": "M.2", "SATA III": "SATA", "SATA 3": "SATA", "PCI EXPRESS": "PCIE"})
_M = lambda s: f"trim(regexp_replace(regexp_replace(upper({s}_model), '\\b(SSD|HDD|NVME|PCIE|PCI EXPRESS|SATA|M\\.2|M2|2280|GEN\\s*\\d+)\\b', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"
_RANK = lambda x: f"CASE {x} WHEN 'SFU' THEN 1 WHEN 'MP510' THEN 2 WHEN 'MP600' THEN 3 WHEN 'P5' THEN 5 END"


def _status(c: str, same: str, one: str) -> str:
    return f"CASE WHEN l_{c} IS NULL AND r_{c} IS NULL THEN 'UNKNOWN' WHEN l_{c} IS NULL OR r_{c} IS NULL THEN '{one}' WHEN {same} THEN 'MATCH' ELSE 'MISMATCH' END"


def judged(pairs: str, warranty: bool = False) -> str:
    """Statuses, confidence and verdict of a relation with l_... and r_... columns, `warranty` among them if asked for."""
    ratio = "abs(l_capacityGB - r_capacityGB)::DOUBLE / nullif(greatest(l_capacityGB, r_capacityGB), 0)::DOUBLE"
    statuses = {
        "manufacturerSku": f"CASE WHEN l_manufacturerSku IS NOT NULL AND r_manufacturerSku IS NOT NULL AND ls <> rs AND (length(ls) < 6 OR length(rs) < 6) THEN 'UNKNOWN' ELSE {_status('manufacturerSku', 'ls = rs', 'MISMATCH')} END",
        "corsair": f"CASE WHEN l_manufacturerSku IS NOT NULL AND r_manufacturerSku IS NOT NULL AND lb = 'CORSAIR' AND rb = 'CORSAIR' THEN CASE WHEN ls = rs OR abs(({_RANK('ls')}) - ({_RANK('rs')})) <= 1 THEN 'MATCH' ELSE 'MISMATCH' END END",
        "brand": _status("brand", "lb = rb", "MISMATCH"),
        "model": _status("model", "lm = rm OR (len(lw) > 0 AND len(rw) > 0 AND CASE WHEN len(lw) <= len(rw) THEN len([x FOR x IN lw IF NOT list_contains(rw, x)]) = 0 ELSE len([x FOR x IN rw IF NOT list_contains(lw, x)]) = 0 END)", "MISMATCH"),
        "family": _status("family", "trim(upper(l_family)) = trim(upper(r_family))", "MISMATCH"),
        "capacity": f"CASE WHEN l_capacityGB IS NULL AND r_capacityGB IS NULL THEN 'UNKNOWN' WHEN l_capacityGB IS NULL OR r_capacityGB IS NULL THEN 'MISMATCH' WHEN {ratio} <= 0.05::DOUBLE THEN 'MATCH' ELSE 'MISMATCH' END",
        "interface": _status("interface", "li = ri OR li || ',' || ri IN ('NVME,M.2', 'M.2,NVME', 'PCIE,M.2', 'M.2,PCIE', 'PCIE,NVME', 'NVME,PCIE')", "UNKNOWN"),
        "protocol": _status("protocol", f"{_I('l', 'protocol')} = {_I('r', 'protocol')}", "UNKNOWN"),
        "pcieGeneration": _status("pcieGeneration", "abs(l_pcieGeneration - r_pcieGeneration) <= 1", "UNKNOWN"),
        "formFactor": _status("formFactor", "trim(upper(l_formFactor)) = trim(upper(r_formFactor))", "UNKNOWN"),
    }
    extra = "CASE WHEN coalesce(l_warranty, r_warranty) IS NULL THEN NULL WHEN abs(l_warranty - r_warranty) <= 1 THEN 'MATCH' ELSE 'MISMATCH' END" if warranty else "NULL::VARCHAR"
    statuses["warranty"] = extra
    is_ = [f"is_{f}" for f in statuses]
    count = lambda v: " + ".join(f"coalesce(({c} = '{v}')::INT, 0)" for c in is_)
    return f"""
    SELECT *, CASE WHEN confidence >= 0.9 THEN 'IDENTICAL' WHEN confidence >= 0.7 THEN 'LIKELY_IDENTICAL' WHEN confidence >= 0.4 THEN 'DIFFERENT' ELSE 'UNKNOWN' END AS verdict
    FROM (SELECT *, CASE WHEN is_brand = 'MISMATCH' OR ((is_manufacturerSku = 'MISMATCH' OR is_corsair = 'MISMATCH') AND length(ls) >= 6 AND length(rs) >= 6) THEN least(raw, 0.39::DOUBLE)
              WHEN is_capacity = 'MISMATCH' OR (is_manufacturerSku <> 'MATCH' AND coalesce(is_corsair, '') <> 'MATCH' AND is_model = 'MISMATCH' AND is_family = 'MISMATCH') THEN least(raw, 0.69::DOUBLE) ELSE raw END AS confidence
          FROM (SELECT *, floor(greatest(0::DOUBLE, least(1::DOUBLE, (total - bad)::DOUBLE / total::DOUBLE - open::DOUBLE / total::DOUBLE * 0.1::DOUBLE)) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS raw
                FROM (SELECT *, 9 + (is_corsair IS NOT NULL)::INT + (is_warranty IS NOT NULL)::INT AS total, {count("MISMATCH")} AS bad, {count("UNKNOWN")} AS open
                      FROM (SELECT *, {", ".join(f"{x} AS is_{f}" for f, x in statuses.items())}
                            FROM (SELECT *, [x FOR x IN string_split(lm, ' ') IF x <> ''] AS lw, [x FOR x IN string_split(rm, ' ') IF x <> ''] AS rw
                                  FROM (SELECT *, {_B("l")} AS lb, {_B("r")} AS rb, {_S("l")} AS ls, {_S("r")} AS rs, {_I("l", "interface")} AS li, {_I("r", "interface")} AS ri, {_M("l")} AS lm, {_M("r")} AS rm
                                        FROM ({pairs}) p0) p1) p2) p3) p4) p5) p6"""


_DISTINCT = f"SELECT {', '.join(INPUTS)}, min(listing_id) AS first, count(*) AS n FROM ({_CANON}) c GROUP BY ALL"


def _side(name: str, alias: str) -> str:
    return ", ".join(f"{alias}.{c} AS {name}_{c}" for c in INPUTS)


_SELF = f"WITH d AS MATERIALIZED ({_DISTINCT}) {judged(f'SELECT a.first AS first, b.first AS second, a.n * b.n AS listing_pairs, {_side("l", "a")}, {_side("r", "b")} FROM d a JOIN d b ON a.first < b.first')}"


def _catalogue_rows(rows: tuple) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in rows) + ") v(item, title)"


def _reason(field: str, status: str, left: str, right: str, both: str, one: str, match: str, mismatch: str, named: bool = False) -> str:
    show = lambda x: f"coalesce({x}, 'Unknown')" if named else f"CASE WHEN {left} IS NULL AND {right} IS NULL THEN 'Unknown' ELSE {x} END"
    why = f"CASE WHEN {left} IS NULL AND {right} IS NULL THEN '{both}' WHEN {left} IS NULL OR {right} IS NULL THEN '{one}' WHEN {status} = 'MATCH' THEN {match} ELSE {mismatch} END"
    return f"{{'f': '{field}', 'l': {show(left)}, 'r': {show(right)}, 'c': CASE {status} WHEN 'MATCH' THEN coalesce({left}, {right}) WHEN 'UNKNOWN' THEN 'Unknown' END, 'w': {why}, 's': {status}}}"


def reported(pairs: str) -> str:
    """(first, item, report) of judged pairs with first and item."""
    ratio = "abs(l_capacityGB - r_capacityGB)::DOUBLE / nullif(greatest(l_capacityGB, r_capacityGB), 0)::DOUBLE"
    short = lambda x: f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"
    ways = "li || ',' || ri IN ('NVME,M.2', 'M.2,NVME', 'PCIE,M.2', 'M.2,PCIE', 'PCIE,NVME', 'NVME,PCIE')"
    # Texts of the reasons.
    rows = [
        _reason("manufacturerSku", "is_manufacturerSku", "l_manufacturerSku", "r_manufacturerSku", "Both SKUs unknown", "One SKU unknown", "'SKU match'", "CASE WHEN is_manufacturerSku = 'UNKNOWN' THEN 'Short SKU token not decisive' ELSE 'SKU mismatch' END"),
        """CASE WHEN is_corsair IS NOT NULL THEN {'f': 'manufacturerSku', 'l': l_manufacturerSku, 'r': r_manufacturerSku, 'c': is_corsair, 'w': CASE WHEN ls = rs THEN 'Corsair SKU exact match' WHEN is_corsair = 'MATCH' THEN 'Corsair submodel proximity'
           WHEN regexp_matches(ls, 'SFU|MP510|MP600|P5') AND regexp_matches(rs, 'SFU|MP510|MP600|P5') THEN 'Corsair submodel mismatch' ELSE 'Corsair SKU comparison' END, 's': is_corsair} END""",
        _reason("brand", "is_brand", "l_brand", "r_brand", "Both brands unknown", "One brand unknown", "CASE WHEN lb <> trim(upper(l_brand)) OR rb <> trim(upper(r_brand)) THEN 'Brand alias match' ELSE 'Brand match' END", "'Brand mismatch'"),
        _reason("model", "is_model", "l_model", "r_model", "Both models unknown", "One model unknown", "'Model token match'", "'Model mismatch'"),
        _reason("family", "is_family", "l_family", "r_family", "Both families unknown", "One family unknown", "'Family match'", "'Family mismatch (' || trim(upper(l_family)) || ' != ' || trim(upper(r_family)) || ')'"),
        _reason("capacity", "is_capacity", "(l_capacityGB || 'GB')", "(r_capacityGB || 'GB')", "Both capacities unknown", "One capacity unknown", f"CASE WHEN {ratio} = 0 THEN 'Capacity match' ELSE 'Capacity match (within 5% tolerance)' END",
                f"'Capacity mismatch (' || l_capacityGB || 'GB vs ' || r_capacityGB || 'GB, diff=' || {short(f'floor({ratio} * 100::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE')} || '%)'", True),
        _reason("interface", "is_interface", "l_interface", "r_interface", "Both interfaces unknown", "One interface unknown", f"CASE WHEN {ways} THEN 'Interface compatible (' || li || '/ ' || ri || ')' ELSE 'Interface match' END", "'Interface mismatch'", True),
        _reason("protocol", "is_protocol", "l_protocol", "r_protocol", "Both protocols unknown", "One protocol unknown", "'Protocol match'", "'Protocol mismatch'", True),
        _reason("pcieGeneration", "is_pcieGeneration", "('Gen' || l_pcieGeneration)", "('Gen' || r_pcieGeneration)", "Both PCIe generations unknown", "One PCIe generation unknown", "CASE WHEN l_pcieGeneration = r_pcieGeneration THEN 'PCIe generation match' ELSE 'Adjacent PCIe generation' END", "'Different PCIe generation'", True),
        _reason("formFactor", "is_formFactor", "l_formFactor", "r_formFactor", "Both form factors unknown", "One form factor unknown", "'Form factor match'", "'Form factor mismatch'", True),
    ]
    part = lambda status, text, none: f"coalesce(nullif(array_to_string([{text} FOR x IN rs_ IF x.s = '{status}'], chr(10)), ''), '{none}')"
    value = lambda x: f"coalesce({x}, 'null')"
    all_ = f"array_to_string([i || '. **' || rs_[i].f || '** — status=' || rs_[i].s || ', left=' || {value('rs_[i].l')} || ', right=' || {value('rs_[i].r')} || ', canonical=' || {value('rs_[i].c')} FOR i IN range(1, len(rs_) + 1)], chr(10))"
    lines = [
        "'# Product Comparison Report'", "''", f"'## Verdict: ' || verdict || ' (confidence: ' || {short('confidence')} || ')'", "''", "'## Identical Specifications'",
        part("MATCH", f"'- **' || x.f || '**: ' || {value('x.c')} || ' (' || x.w || ')'", "- None"), "''", "'## Differing Specifications'",
        part("MISMATCH", f"'- **' || x.f || '**: ' || {value('x.l')} || ' vs ' || {value('x.r')} || ' (' || x.w || ')'", "- None"), "''", "'## Unknown Specifications'",
        part("UNKNOWN", "'- **' || x.f || '**: ' || x.w", "- None (all fields resolved)"), "''", "'## All ComparisonReason Objects'", "''", all_, "''",
    ]
    return f"SELECT first, item, {' || chr(10) || '.join(lines)} AS report FROM (SELECT *, [x FOR x IN [{', '.join(rows)}] IF x IS NOT NULL] AS rs_ FROM ({pairs}) j) k"


def greedy(pairs: str, alone: str, key: str) -> str:
    """Offers from judged pairs (first, second, verdict, confidence): taken in order while both sides are free; then rows of `alone`."""
    return f"""
    WITH RECURSIVE m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first, second) AS n FROM ({pairs}) p WHERE verdict IN ('IDENTICAL', 'LIKELY_IDENTICAL')),
    g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS hit
          UNION ALL SELECT g.n + 1, CASE WHEN list_contains(g.used, m.first) OR list_contains(g.used, m.second) THEN g.used ELSE list_concat(g.used, [m.first, m.second]) END,
                           CASE WHEN list_contains(g.used, m.first) OR list_contains(g.used, m.second) THEN NULL ELSE m.n END
          FROM g JOIN m ON m.n = g.n + 1),
    t AS (SELECT m.first, m.second, m.verdict, m.confidence FROM m JOIN g ON m.n = g.hit)
    SELECT * FROM t UNION ALL SELECT {key}, NULL, 'UNKNOWN', 0.5::DOUBLE FROM ({alone}) a WHERE {key} NOT IN (SELECT first FROM t UNION ALL SELECT second FROM t)"""


def build(catalogue: tuple, messages: tuple, query: str, categories: tuple) -> dict[str, str]:
    """SQL by query name; the arguments are the constants of the queries."""
    cat = canonical(_catalogue_rows(catalogue))
    against = judged(f"SELECT d.first AS first, d.n AS n, c.item AS item, {_side('l', 'd')}, {_side('r', 'c')} FROM ({_DISTINCT}) d CROSS JOIN ({cat}) c")
    every = judged(f"SELECT d.listing_id AS listing_id, c.item AS item, {_side('l', 'd')}, {_side('r', 'c')} FROM ({_CANON}) d CROSS JOIN ({cat}) c")
    months = "CASE WHEN n <> '' THEN n::INT * CASE WHEN starts_with(u, 'ano') THEN 12 ELSE 1 END END AS warranty"
    with_months = lambda source: f"SELECT *, {months} FROM (SELECT *, regexp_extract(lower(title), 'garantia (?:de )?([0-9]{{1,2}}) (?:anos?|mes|mês)', 1) AS n, regexp_extract(lower(title), 'garantia (?:de )?[0-9]{{1,2}} (anos?|mes|mês)', 1) AS u FROM ({source}) w0) w1"
    guaranteed = f"SELECT {', '.join(INPUTS)}, warranty, min(id) AS first FROM ({with_months(canonical(PRODUCTS))}) c GROUP BY ALL"
    warranties = judged(f"SELECT d.first AS first, c.item AS item, d.warranty AS l_warranty, 12 * (c.item % 4) AS r_warranty, {_side('l', 'd')}, {_side('r', 'c')} FROM ({guaranteed}) d CROSS JOIN ({cat}) c", warranty=True)
    failed = f"""(SELECT event_id, ts, [{", ".join(map(_quote, messages))}][event_id % {len(messages)} + 1] AS message, ['Error', 'TimeoutError', 'TypeError'][event_id % 3 + 1] AS name FROM events WHERE event_type = 'error')"""
    kind = """CASE WHEN regexp_matches(message, '(?i)busy|try again|temporary|unavailable|refused') THEN 'transient'
        WHEN regexp_matches(message, '(?i)timeout|timed out|network|net::|cloudflare|403|429|rate limit|session|page') THEN 'retriable'
        WHEN regexp_matches(message, '(?i)not found|404|invalid|bad argument|cannot read|undefined|does not exist') THEN 'permanent'
        WHEN contains(name, 'Timeout') THEN 'retriable' WHEN contains(name, 'TypeError') THEN 'permanent' ELSE 'unknown' END"""
    category = """CASE WHEN regexp_matches(message, 'Cloudflare|Pru Pru|Manutenção|403|429') THEN 'cloudflare' WHEN regexp_matches(message, 'timeout|timed out') OR contains(name, 'Timeout') THEN 'timeout'
        WHEN regexp_matches(message, 'navigation|navigate|Navigation') THEN 'navigation' WHEN regexp_matches(message, 'selector|Selector|not found') THEN 'selector'
        WHEN regexp_matches(message, 'network|DNS|net::|ECONNREFUSED|Error') THEN 'network_dns' ELSE 'other' END"""
    priced = f"(SELECT *, {parse_price('price_text')} AS price FROM ({_CANON}) c)"
    tokens = f"""(SELECT listing_id, title, list_concat([{{'t': lower(x), 'k': CASE WHEN list_contains([{", ".join(_quote(b.lower()) for b in BRANDS)}], lower(x)) THEN 'brand'
          WHEN regexp_matches(x, '\\d') AND length(x) <= 8 THEN 'model' WHEN regexp_matches(x, '(?i)^(in|inch|inches|pol|pulgadas|gb|tb|m\\.2|nvme|ssd|hdd|ddr|sata|pci)$') THEN 'unit' ELSE 'generic' END}} FOR x IN regexp_split_to_array(title, '\\s+')],
          CASE WHEN b IS NOT NULL THEN [{{'t': lower(b), 'k': 'brand'}}] ELSE [] END, CASE WHEN m IS NOT NULL THEN [{{'t': lower(m), 'k': 'model'}}] ELSE [] END) AS ts
        FROM (SELECT l.listing_id, {clean("title")} AS title, {brand("title")} AS b, mo.model AS m FROM {L} l JOIN ({_MODEL}) mo ON l.listing_id = mo.listing_id) q)"""
    asked = query_tokens(query)

    def hit(text: str, k: str) -> str:
        if k == "unit":
            return f"len([x FOR x IN ts IF contains(x.t, 'in') OR contains(x.t, 'gb') OR contains(x.t, 'tb') OR contains(x.t, '{text}')]) > 0"
        return f"len([x FOR x IN ts IF x.t = '{text}'" + (f" OR x.k = '{k}'" if k in ("model", "brand") else "") + "]) > 0"

    hits = [hit(t, k) for t, k in asked]
    got = " + ".join(["0::DOUBLE", *[f"CASE WHEN {h} THEN {WEIGHTS[k]}::DOUBLE ELSE 0::DOUBLE END" for h, (_, k) in zip(hits, asked, strict=True)]])
    total = sum(WEIGHTS[k] for _, k in asked)
    scored = f"""SELECT listing_id, title, least(({got}) / {total!r}::DOUBLE, 1::DOUBLE) AS score, concat_ws(' ', {", ".join(f"CASE WHEN {h} THEN '{t}' END" for h, (t, _) in zip(hits, asked, strict=True))}) AS matched,
        concat_ws(' ', {", ".join(f"CASE WHEN NOT ({h}) THEN '{t}' END" for h, (t, _) in zip(hits, asked, strict=True))}) AS unmatched FROM {tokens} z"""
    dedup = lambda source, order, cols: f"""
    WITH s AS ({source}),
    u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (coalesce(source, '') = '')::INT, {order}) AS rn, min({order}) OVER (PARTITION BY url) AS place FROM s WHERE coalesce(url, '') <> ''),
    t AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(coalesce(title, ''))), coalesce(nullif(lower(trim(provider)), ''), lower(trim(source)), ''), CASE WHEN trim(coalesce(title, '')) = '' THEN {order} END ORDER BY place) AS rt FROM u WHERE rn = 1)
    SELECT {cols} FROM t WHERE rt = 1"""  # noqa: E731
    slug = "replace(replace(replace(replace(replace(replace(replace(url_encode(trim(searchquery)), '%20', '-'), '+', '-'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
    page = lambda u: f"CASE WHEN regexp_extract({u}, '[?&]page=([^&#]*)', 1) = '' THEN 0 WHEN regexp_matches(regexp_extract({u}, '[?&]page=([^&#]*)', 1), '^[0-9]{{1,9}}$') THEN regexp_extract({u}, '[?&]page=([^&#]*)', 1)::INT END"
    runs = lambda keys, source: f"SELECT {keys}, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, avg((coalesce(status, '') = 'success')::INT) AS success_rate, avg(executiontime) AS avg_ms, min(executiontime) AS min_ms, max(executiontime) AS max_ms, avg(productcount) FILTER (status = 'success') AS avg_rows, sum(productcount)::BIGINT AS total_rows FROM {source} GROUP BY {keys}"
    rows = f"""SELECT s.id, s.provider, s.status, coalesce(r.n, 0) AS raw, coalesce(n.n, 0) AS normalized FROM searches s
      LEFT JOIN (SELECT searchid, count(*) AS n FROM {RAW} x GROUP BY 1) r ON s.id = r.searchid LEFT JOIN (SELECT searchid, count(*) AS n FROM normalized_products GROUP BY 1) n ON s.id = n.searchid"""
    legacy = lambda c, same, one="FALSE": f"CASE WHEN l_{c} IS NULL AND r_{c} IS NULL THEN TRUE WHEN l_{c} IS NULL OR r_{c} IS NULL THEN {one} ELSE coalesce({same}, FALSE) END"
    up = lambda c: (f"trim(upper(l_{c}))", f"trim(upper(r_{c}))")
    eq = lambda c: "{} = {}".format(*up(c))
    either = lambda c, ok: "{0} = {1} OR {0} || ',' || {1} IN ({2})".format(*up(c), ok)
    return {
        "clean_titles": f"SELECT id, {clean('originaltitle')} AS title FROM normalized_products",
        "title_attributes": f"SELECT listing_id, {clean('title')} AS clean, {brand('title')} AS brand, {storage_capacity('title')} AS storage, {memory_capacity('title')} AS memory, {availability('title', 'price_text', 'provider')} AS availability FROM {L} l",
        "title_models": _MODEL,
        "listing_capacities": f"SELECT id, {storage_capacity('originaltitle')} AS storage, {memory_capacity('originaltitle')} AS memory, {availability('originaltitle', 'pricetext', 'provider')} AS availability FROM normalized_products",
        "parsed_prices": f"SELECT id, {parse_price('pricetext')} AS parsed, {stored_price('pricetext')} AS stored FROM {RAW} r",
        "listing_prices": f"SELECT id, now AS current, {original_price('now', 'pricetext')} AS original, CASE WHEN price IS NULL THEN 'N/A' ELSE 'R$ ' || replace(format('{{:,}}', c // 100), ',', '.') || ',' || lpad((c % 100)::VARCHAR, 2, '0') END AS shown FROM (SELECT id, price, pricetext, coalesce(price, {parse_price('pricetext')}) AS now, floor(price * 100 + 0.5)::BIGINT AS c FROM {RAW} r) x",
        "canonical_devices": f"""SELECT listing_id, brand, model, family, manufacturerSku AS "manufacturerSku", capacityGB AS "capacityGB", capacityTB AS "capacityTB", coalesce(capacityGB || 'GB', '') AS "canonicalCapacity", interface, protocol, pcieGeneration AS "pcieGeneration", formFactor AS "formFactor",
            conf_brand, conf_model, "conf_capacityGB", conf_interface, conf_protocol, "conf_pcieGeneration", "conf_formFactor", "conf_manufacturerSku", conf_overall FROM ({_SURE}) s""",
        "flat_devices": f"""SELECT listing_id, coalesce(brand, 'Unknown') AS brand, coalesce(model, 'Unknown') AS model, family, coalesce(capacityGB::DOUBLE, capacityTB) AS capacity, CASE WHEN capacityTB <> 0 THEN 'TB' ELSE 'GB' END AS "capacityUnit", conf_overall AS overall FROM ({_SURE}) s""",
        "compare_catalogue": f"SELECT listing_id, item, verdict, confidence, is_manufacturerSku AS \"is_manufacturerSku\", is_corsair, is_brand, is_model, is_family, is_capacity, is_interface, is_protocol, is_pcieGeneration AS \"is_pcieGeneration\", is_formFactor AS \"is_formFactor\" FROM ({every}) e",
        "comparison_reports": reported(against),
        "greedy_offers": greedy(f"SELECT first, second, verdict, confidence FROM ({_SELF}) s", _DISTINCT, "first"),
        "warranty_pairs": f"SELECT first, item, verdict, confidence, is_warranty FROM ({warranties}) w",
        "product_rows": f"""SELECT p.id, {clean("title")} AS normalized_title, {brand("title")} AS brand, m.model, {storage_capacity("title")} AS storage_capacity, {memory_capacity("title")} AS memory_capacity, 'BRL' AS currency,
            {parse_price("pricetext")} AS current_price, {original_price(parse_price("pricetext"), "pricetext")} AS original_price, {availability("title", "pricetext", "provider")} AS availability, 1.0::DOUBLE AS confidence
            FROM ({PRODUCTS}) p JOIN ({model(PRODUCTS, "id")}) m ON p.id = m.id""",
        "product_devices": f"""SELECT id, brand, model, family, manufacturerSku AS "manufacturerSku", capacityGB AS "capacityGB", interface, protocol, pcieGeneration AS "pcieGeneration", formFactor AS "formFactor" FROM ({canonical(PRODUCTS)}) c""",
        "compare_distinct": f"SELECT first, second, verdict, confidence FROM ({_SELF}) s",
        "matching_devices": f"SELECT first, second, verdict, confidence, listing_pairs FROM ({_SELF}) s WHERE verdict IN ('IDENTICAL', 'LIKELY_IDENTICAL')",
        "field_matchers": f"""SELECT first, item, {legacy("manufacturerSku", "regexp_replace(upper(l_manufacturerSku), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(r_manufacturerSku), '[^A-Z0-9]', '', 'g')")} AS sku,
            {legacy("brand", eq("brand") + " OR (trim(upper(l_brand)) = 'WD' AND trim(upper(r_brand)) IN ('WESTERN DIGITAL', 'WD BLUE')) OR (trim(upper(l_brand)) = 'WESTERN DIGITAL' AND trim(upper(r_brand)) = 'WD')")} AS brand,
            {legacy("model", "list_has_any(regexp_extract_all(l_model, '[0-9]+'), regexp_extract_all(r_model, '[0-9]+')) OR " + eq("model"))} AS model, {legacy("family", eq("family"), "TRUE")} AS family,
            {legacy("capacityGB", "abs(l_capacityGB - r_capacityGB)::DOUBLE / greatest(l_capacityGB, r_capacityGB)::DOUBLE <= 0.05::DOUBLE")} AS capacity, {legacy("interface", either("interface", "'NVME,M.2', 'M.2,NVME', 'PCIE,M.2', 'M.2,PCIE', 'PCIE,NVME', 'NVME,PCIE'"))} AS interface,
            {legacy("protocol", eq("protocol"))} AS protocol, {legacy("pcieGeneration", "abs(l_pcieGeneration - r_pcieGeneration) <= 1")} AS "pcieGeneration", {legacy("formFactor", eq("formFactor"))} AS "formFactor"
            FROM (SELECT d.first AS first, c.item AS item, {_side("l", "d")}, {_side("r", "c")} FROM ({_DISTINCT}) d CROSS JOIN ({cat}) c) p""",
        "match_quality": f"""SELECT *, 2.0::DOUBLE * precision * recall / nullif(precision + recall, 0) AS f1 FROM (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM (
            SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (
            SELECT verdict IN ('IDENTICAL', 'LIKELY_IDENTICAL') AS p, l_brand IS NOT DISTINCT FROM r_brand AND l_model IS NOT DISTINCT FROM r_model AND l_capacityGB IS NOT DISTINCT FROM r_capacityGB AS a FROM ({against}) g) h) i) j""",
        "relevance_scores": f"SELECT listing_id, score, matched, unmatched FROM ({scored}) s",
        "relevant_listings": f"SELECT listing_id, title, score FROM ({scored}) s WHERE score >= 0.6::DOUBLE",
        "search_statistics": f"SELECT count(*) AS total, count(*) FILTER (score >= 0.3::DOUBLE) AS kept, count(*) FILTER (score < 0.3::DOUBLE) AS filtered FROM ({scored}) s",
        "deduplicated": dedup(f"SELECT *, CASE WHEN listing_id % 2 = 0 THEN provider END AS source FROM {L} l", "listing_id", "listing_id, title, provider, url"),
        "raw_deduplicated": dedup(f"SELECT id, provider, title, url, source FROM {RAW} r", "id", "id"),
        "first_titles": f"SELECT listing_id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY listing_id) AS rn FROM {L} l WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '') x WHERE rn = 1",
        "shop_listings": f"SELECT listing_id, title, {parse_price('price_text')} AS price, 'https://kabum.example' || regexp_replace(url, '^https://[^/]+', '') AS url, 'kabum' AS source FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY listing_id) AS rn FROM {L} l WHERE provider = 'kabum' AND url IS NOT NULL) x WHERE rn = 1",
        "provider_union": f"SELECT listing_id, provider, title FROM {L} l",
        "provider_summary": f"SELECT provider, count(*) AS listings, count(price) AS priced, min(price) AS least, max(price) AS most FROM {priced} p GROUP BY provider",
        "brand_prices": f"SELECT provider, brand, count(*) AS listings, min(price) AS least FROM {priced} p GROUP BY provider, brand",
        "listing_rollup": f"SELECT provider, brand, grouping(provider, brand) AS level, count(*) AS listings, min(price) AS least FROM {priced} p GROUP BY ROLLUP (provider, brand)",
        "listing_validity": f"SELECT provider, bool_and(coalesce(price > 0, FALSE)) AS valid_price, bool_and(trim(coalesce(title, '')) <> '') AS valid_title, bool_and(coalesce(starts_with(url, 'http'), FALSE)) AS valid_url, count(*) AS listings, count(DISTINCT title) AS titles FROM {RAW} r GROUP BY provider",
        "page_overlap": f"WITH a AS (SELECT DISTINCT title FROM {L} l WHERE provider = 'pichau'), b AS (SELECT DISTINCT title FROM {L} l WHERE provider = 'mercadolivre') SELECT title, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT title, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y",
        "run_statistics": runs("provider", "searches"),
        "query_statistics": f"SELECT provider, query, runs, min_ms, max_ms, avg_ms FROM ({runs('provider, query', '(SELECT *, lower(trim(searchquery)) AS query FROM searches)')}) r",
        "page_success": "SELECT provider, page, count(*) AS runs, count(*) FILTER (status = 'success') AS successes FROM (SELECT *, try_cast(json_extract_string(pagination, '$.currentPage') AS INT) AS page FROM searches) s GROUP BY provider, page",
        "engine_deltas": "SELECT *, click - view AS delta FROM (SELECT user_id, sum(c) FILTER (event_type = 'view')::DOUBLE / count(*) FILTER (event_type = 'view') / 100::DOUBLE AS view, sum(c) FILTER (event_type = 'click')::DOUBLE / count(*) FILTER (event_type = 'click') / 100::DOUBLE AS click FROM (SELECT *, floor(value * 100::DOUBLE + 0.5::DOUBLE)::BIGINT AS c FROM events) ev WHERE event_type IN ('view', 'click') GROUP BY user_id) x",
        "failure_classes": f"SELECT event_id, kind, category, event_id % 5 < 3 AND kind IN ('retriable', 'transient') AS retry, least(500::DOUBLE * pow(2::DOUBLE, event_id % 5), 5000::DOUBLE) AS delay_ms FROM (SELECT event_id, {kind} AS kind, {category} AS category FROM {failed} f) x",
        "failure_pivot": f"SELECT strftime(ts, '%Y-%m-%d') AS day, {', '.join(f"count(*) FILTER (category = '{c}') AS {c}" for c in categories)} FROM (SELECT ts, {category} AS category FROM {failed} f) x GROUP BY 1",
        "failure_distribution": f"SELECT category, count(*) AS n FROM (SELECT {category} AS category FROM {failed} f) x GROUP BY category ORDER BY n DESC, category",
        "search_urls": f"SELECT id, {slug} AS slug, 'https://lista.example/' || {slug} || CASE WHEN coalesce(productcount % 4, 1) <= 1 THEN '' ELSE '_Desde_' || ((productcount % 4 - 1) * 48 + 1) || '_NoIndex_True' END AS url FROM searches",
        "search_pages": f"""
            WITH s AS (SELECT id, url, coalesce(productcount, 0) AS n FROM searches WHERE url IS NOT NULL),
            k AS (SELECT id, CASE WHEN n % 3 = 0 THEN url ELSE url || '&page=' || (n % 7 + 1) END AS here, [url || '&page=' || (n % 7 + 3), url || '&page=' || (n % 7), url || '&page=' || (n % 7 + 1), url || '&page=' || (n % 7 + 3), url || '&page=x', url] AS links FROM s),
            c AS (SELECT *, CASE WHEN regexp_matches(here, '[?&]page=[^&#]') THEN {page("here")} ELSE 1 END AS cur FROM k),
            x AS (SELECT id, cur, u, {page("u")} AS p, i FROM (SELECT id, cur, unnest(links) AS u, unnest(range(1, 7)) AS i FROM c) y)
            SELECT id, cur AS "currentPage", array_to_string(list_sort(list(DISTINCT p)), ',') AS pages, arg_min(u, p * 100 + i) FILTER (p > cur) AS "nextPageUrl", count(*) FILTER (p > cur) > 0 AS "hasNextPage" FROM x WHERE p IS NOT NULL GROUP BY id, cur""",
        "page_cards": f"SELECT k // 40 AS page, (row_number() OVER (PARTITION BY k // 40 ORDER BY k) - 1)::INT AS pos, title, price_text, nullif(coalesce(url, ''), '') AS url FROM {L} l WHERE provider = 'pichau'",
        "plain_page_cards": f"SELECT page, pos, replace(title, 'Produto Patrocinado ', '') AS title, price_text, '/produto/' || k || '/x' AS url FROM (SELECT *, k // 100 AS page, (row_number() OVER (PARTITION BY k // 100 ORDER BY k) - 1)::INT AS pos FROM {L} l WHERE provider = 'kabum') x WHERE pos < 80",
        "listed_page_cards": f"SELECT page, pos, title, price_text, url FROM (SELECT *, k // 48 AS page, (row_number() OVER (PARTITION BY k // 48 ORDER BY k) - 1)::INT AS pos FROM {L} l WHERE provider = 'mercadolivre') x WHERE k % 10 <> 0 AND k % 11 <> 0",
        "page_codes": f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 < 4 THEN 'NO_PRODUCTS' END ELSE CASE {category} WHEN 'cloudflare' THEN 'CLOUDFLARE' WHEN 'timeout' THEN 'TIMEOUT' WHEN 'selector' THEN 'INPUT_NOT_FOUND' WHEN 'other' THEN 'DOM_CHANGED' ELSE 'NAVIGATION' END END AS code,
            event_id % 5 = 0 AS blocked, CASE WHEN event_id % 4 <> 0 THEN {kind} WHEN contains(name, 'Timeout') THEN 'retriable' WHEN contains(name, 'TypeError') THEN 'permanent' ELSE 'unknown' END AS label FROM {failed} f""",
        "page_validity": "SELECT id, coalesce(ok, FALSE) AS valid, coalesce(ok AND c = 1, FALSE) AS first_page FROM (SELECT id, try_cast(json_extract_string(pagination, '$.currentPage') AS INT) AS c, json_array_length(pagination, '$.pages') > 0 AND try_cast(json_extract_string(pagination, '$.currentPage') AS INT) IS NOT NULL AND json_extract_string(pagination, '$.hasNextPage') IS NOT NULL AS ok FROM searches) x",
        "search_products": f"""SELECT s.id, s.status, coalesce(r.ids, '') AS raw, coalesce(n.ids, '') AS normalized, n.first_brand FROM searches s LEFT JOIN (SELECT searchid, string_agg(id, ',' ORDER BY id) AS ids FROM {RAW} x GROUP BY 1) r ON s.id = r.searchid
            LEFT JOIN (SELECT searchid, string_agg(id, ',' ORDER BY id) AS ids, (list(brand ORDER BY id))[1] AS first_brand FROM normalized_products GROUP BY 1) n ON s.id = n.searchid""",
        "search_rows": rows,
        "table_counts": "SELECT s AS searches, r AS raw, n AS normalized, r + n AS products FROM (SELECT (SELECT count(*) FROM searches) AS s, (SELECT count(*) FROM raw_products) AS r, (SELECT count(*) FROM normalized_products) AS n) x",
        "search_states": f"SELECT x.id, CASE WHEN x.raw > 0 THEN 'success' ELSE 'partial' END AS state, CASE WHEN s.executiontime < 1000 THEN s.executiontime || 'ms' WHEN s.executiontime IS NOT NULL THEN (floor(s.executiontime / 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT // 10) || '.' || (floor(s.executiontime / 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT % 10) || 's' END AS took FROM ({rows}) x JOIN searches s ON x.id = s.id",
    }
