"""Names: personal-data classification of table and column names, safe file names.

``matches`` and ``file_base`` are Columns; the identifier rules need tokenising by letter case and run as an Arrow UDF
over names, which are few. A dictionary is a list of terms (``DEFAULT_TERMS`` or your own): a term with ``_`` stands for all
its spellings with the separators in ``SEPARATORS``. A classifier only tags; what happens to a table is the caller's policy.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of compound terms.
SEPARATORS = ("", "_", "-", ".", " ", "__")
#: Compact names that never match.
STOP_NAMES = ("productname", "filename", "displayname", "orderstate", "filehash", "settings")
#: Our own short default dictionary, terms found anywhere in a name. A complete one is a parameter: see load_terms().
DEFAULT_TERMS = tuple(
    """name nm user usr cust customer client contact owner person people member acc account prof profile emp employee staff admin author buyer vendor visitor
    holder guest student patient applicant subscriber billing nick alias login pass pwd hash salt crypt mail emal correo tel phone mobile cell whatsapp
    zip post_code postal po_box addr street city town village district region province county state country dob date_of_birth birth born gender sex
    ssn tin iin inn npwp pan dni curp pesel aadhaar passport pasporte paspor visa national_id id_card driver_license cedula usuario nombre apellido clave
    fecha_nacimiento direccion calle ciudad pais utilisateur adresse rue ville courriel naissance strasse stadt plz geschlecht
    nama alamat surel sandi lahir kota jalan hp имя фамилия фам отчество фио тел почта пароль хеш адрес улица город дом паспорт снилс огрн инн иин
    дата_рождения пол логин клиент імя прізвище пошта 姓 名 用户 客户 联系人 邮箱 密码 手机 电话 地址 城市 国家 护照 生日 性别 账号""".split()
)
#: Endings of reference columns, document identifiers found anywhere, and short ones found as whole parts.
ID_ENDINGS = ("identifier", "uuid", "guid", "id")
DOCUMENT_TERMS = tuple("passport pasaporte passaporte passeport passaporto reisepass paspor pasport паспорт 护照 護照 huzhao nationalid natid idcard identitycard driverlicense driverlicence drivinglicense drivinglicence dlnumber licenceno aadhaar aadhar pesel cnic curp cedula cédula снилс огрн рнокпп rnokpp".split())
DOCUMENT_PARTS = frozenset("ssn tin itin ein nino nhs pan nik ktp npwp sim visa dni nie cif rfc iin inn инн іпн ипн".split())
#: Device names that no file may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)))
MAX_UNITS = 251
_SEPARATOR = r"[\s_.\-]+"


def load_terms(path: str) -> tuple[str, ...]:
    """A dictionary from a text file: one term a line, ``#`` begins a comment; blank lines don't count."""
    with open(path, encoding="utf-8-sig") as f:
        return tuple(dict.fromkeys(t for line in f if (t := line.split("#", 1)[0].strip())))


@lru_cache(maxsize=8)
def spellings(terms: tuple[str, ...] = DEFAULT_TERMS) -> tuple[str, ...]:
    """All terms with all separators, sorted."""
    out = set()
    for t in terms:
        parts = [p for p in re.split("[_-]", t.lower()) if p]
        out.update({s.join(parts) for s in SEPARATORS} if len(parts) > 1 else parts)
    return tuple(sorted(out))


def compact(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), _SEPARATOR, "")


def matches(name: Column, terms: tuple[str, ...] = DEFAULT_TERMS) -> Column:
    """Whether a name holds a term; one alternation, shortest irreducible terms only. Null: false."""
    found = spellings(terms)
    least = [t for t in found if not any(o != t and o in t for o in found)]
    pattern = "|".join(re.escape(t) for t in least)
    return F.coalesce(~compact(name).isin(*STOP_NAMES) & F.lower(name).rlike(pattern), F.lit(False))


def name_matches(name: str, terms: tuple[str, ...] = DEFAULT_TERMS) -> bool:
    """The same rule for one string."""
    low = name.lower()
    return re.sub(_SEPARATOR, "", low) not in STOP_NAMES and any(t in low for t in spellings(terms))


def _bare(part: str) -> str:
    return re.sub(r"\d+$", "", part)


def is_reference(name: str, terms: tuple[str, ...] = DEFAULT_TERMS) -> bool:
    """Whether a column is a technical reference: user_id, customerGuid, userid, user_id_2."""
    parts = [p for p in re.split(_SEPARATOR, name) if p]
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    last = _bare(parts[-1])
    low = last.lower()
    for e in ID_ENDINGS:
        if low == e and len(parts) > 1:
            return True
        if low.endswith(e) and len(low) > len(e) and (last[-len(e)].isupper() or low[: -len(e)] in spellings(terms)):
            return True
    return False


def is_document(name: str) -> bool:
    """Whether a column names a government or document identifier, which counts even with an id ending."""
    packed = re.sub(_SEPARATOR, "", name.lower())
    if any(t in packed for t in DOCUMENT_TERMS):
        return True
    words = re.sub(r"(?<=[a-zа-я\d])(?=[A-ZА-Я])|(?<=[A-ZА-Я])(?=[A-ZА-Я][a-zа-я])", " ", name)
    if any(_bare(w.lower()) in DOCUMENT_PARTS for w in re.split(_SEPARATOR, words)):
        return True
    stem = _bare(packed)
    return any(stem.endswith(e) and stem[: -len(e)].endswith(tuple(DOCUMENT_PARTS)) for e in ID_ENDINGS)


def table_wanted(terms: tuple[str, ...] = DEFAULT_TERMS):
    """A predicate (table, columns) for readers: whether the table carries personal data."""
    return lambda table, columns: name_matches(table or "", terms) or columns_match(columns, terms)


def columns_match(names: list[str] | None, terms: tuple[str, ...] = DEFAULT_TERMS, least: int = 2) -> bool:
    """Whether at least ``least`` distinct columns (trimmed, by lower case) carry personal data."""
    firsts: dict[str, str] = {}
    for n in names or []:
        if n and n.strip():
            firsts.setdefault(n.strip().lower(), n.strip())
    return sum(is_document(n) or (name_matches(n, terms) and not is_reference(n, terms)) for n in firsts.values()) >= least


def columns_match_udf(terms: tuple[str, ...] = DEFAULT_TERMS):
    """columns_match over an array column, batch by batch."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def run(names: pa.Array) -> pa.Array:
        return pa.array([columns_match(n, terms) for n in names.to_pylist()], pa.bool_())

    return run


def verdict(table: Column, columns: Column, terms: tuple[str, ...] = DEFAULT_TERMS) -> Column:
    """Table name matches, or its columns do."""
    return matches(table, terms) | columns_match_udf(terms)(columns)


def file_base(name: Column, empty: str = "table") -> Column:
    """A name safe for files: illegal characters become ``_``, trailing blanks and dots go, device names get ``_``."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]', "_")
    safe = F.regexp_replace(safe, r"[ .]+$", "")
    stem = F.upper(F.substring_index(safe, ".", 1))
    return F.when(safe == "", F.lit(empty)).when(stem.isin(*RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)


def safe_base(name: str | None, empty: str = "table") -> str:
    """file_base() for one string."""
    safe = re.sub(r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]', "_", name or "").rstrip(" .")
    if not safe:
        return empty
    return f"_{safe}" if safe.split(".", 1)[0].upper() in RESERVED else safe


def sheet_base(book: str, sheet: str) -> str:
    """File base of a sheet: that of its book and its own."""
    return f"{safe_base(book, 'book')}_{safe_base(sheet, 'sheet')}"


def limited(name: str, suffix: str = "", units: int = MAX_UNITS) -> str:
    """A file base of at most ``units`` UTF-16 units: a longer one keeps a prefix, ``~`` and 16 hex digits of its sha256."""
    size = lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2
    if size(name) + size(suffix) <= units:
        return name + suffix
    tail = f"~{hashlib.sha256(name.encode()).hexdigest()[:16]}{suffix}"
    out = name.encode("utf-16-le", "surrogatepass")[: 2 * max(0, units - size(tail))].decode("utf-16-le", "ignore")
    return out + tail


def limited_name(name: Column, suffix: Column | str = "", units: int = MAX_UNITS) -> Column:
    """limited() as a Column, for all code points: those beyond the Basic Multilingual Plane take two units."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    wide = r"([\x{10000}-\x{10FFFF}])"
    # behind each wide code point stands a mark that no text has, so that characters are units
    marked = lambda x: F.regexp_replace(x, wide, "$1\uffff")
    room = F.greatest(F.lit(units - 17) - F.char_length(marked(suffix)), F.lit(0))
    cut = F.regexp_replace(F.substring(marked(name), F.lit(1), room), wide + "$", "")
    short = F.concat(F.replace(cut, F.lit("\uffff"), F.lit("")), F.lit("~"), F.substring(F.sha2(name, 256), 1, 16), suffix)
    return F.when(F.char_length(marked(name)) + F.char_length(marked(suffix)) <= units, F.concat(name, suffix)).otherwise(short)


def part_name(stem: Column, part: Column) -> Column:
    """Name of a split part: the first keeps the stem, others get ``_n``, within the limit of names."""
    return F.when(part <= 1, limited_name(stem)).otherwise(limited_name(stem, F.concat(F.lit("_"), part.cast("string"))))
