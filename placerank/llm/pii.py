"""Personal data: validated values are replaced by keyed pseudonyms of the same format.

Each value is taken apart into what its format fixes (separators, country code, check digits, domain of an address) and a
number from a known range, which a Feistel network permutes: a one-to-one map for a key and a kind, so equal values
get equal pseudonyms in all documents and different ones stay different. Numbers beyond the range (days past the last year) are
permuted again until they fall inside. Every pseudonym has the length of its value and passes the same validation."""

import datetime
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ["secret", "email", "iban", "ip", "date", "phone", "ssn", "card"]


class Feistel:
    """Keyed permutations of digit strings in any radix and of ranges of integers."""

    def __init__(self, key: bytes):
        self.key = blake2b(key).digest()

    def _round(self, kind: str, nth: int, size: tuple, value: int, modulus: int) -> int:
        said = f"{kind}|{nth}|{size}|{value}".encode()
        return int.from_bytes(blake2b(said, key=self.key, digest_size=40).digest(), "big") % modulus

    def digits(self, value: int, radix: int, length: int, kind: str) -> int:
        """Permute the numbers below radix ** length."""
        if length < 1:
            return value
        if length == 1:
            return (value + self._round(kind, 0, (radix, 1), 0, radix)) % radix
        u = length // 2
        low = (radix ** u, radix ** (length - u))
        a, b = divmod(value, low[1])
        for nth in range(ROUNDS):
            # a and b change places each round, and so do their ranges.
            a, b = b, (a + self._round(kind, nth, (radix, length), b, low[nth % 2])) % low[nth % 2]
        return a * low[1] + b

    def below(self, value: int, size: int, kind: str, fits=lambda v: True) -> int:
        """Permute the numbers below `size` that fit; `value` must be one."""
        bits = max(2, (size - 1).bit_length())
        while True:
            value = self.digits(value, 2, bits, f"{kind}/{size}")
            if value < size and fits(value):
                return value


def luhn(digits: str) -> int:
    """What the last digit lacks to make the sum a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _refill(shape: str, symbols: str, fresh: str) -> str:
    """`shape` with its characters from `symbols` replaced in turn."""
    new = iter(fresh)
    return "".join(next(new) if c in symbols else c for c in shape)


_DIGITS, _LOWER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _digits(self, text: str, kind: str, skip: int = 0) -> str:
        own = [c for c in text if c in _DIGITS]
        rest = "".join(own[skip:])
        if not rest:
            return text
        new = str(self.feistel.digits(int(rest), 10, len(rest), f"{kind}/{''.join(own[:skip])}")).zfill(len(rest))
        return _refill(text, _DIGITS, "".join(own[:skip]) + new)

    def _places(self, text: str, kind: str, letters: str = _LOWER) -> str:
        """Permute digits among digits and letters among `letters` at once; their case stays."""
        own = [(letters if c.lower() in letters else _DIGITS, c) for c in text if c.isascii() and c.isalnum()
               and (c.lower() in letters or c in _DIGITS)]
        value, size = 0, 1
        for symbols, c in own:
            value, size = value * len(symbols) + symbols.index(c.lower()), size * len(symbols)
        shape = "".join("9" if s is _DIGITS else "a" for s, _ in own)
        value, new = self.feistel.below(value, size, f"{kind}/{shape}") if own else 0, []
        for symbols, c in reversed(own):
            value, d = divmod(value, len(symbols))
            new.append(symbols[d].upper() if c.isupper() else symbols[d])
        places = iter(reversed(new))
        known = letters + _DIGITS
        return "".join(next(places) if c.isascii() and c.lower() in known else c for c in text)

    def secret(self, text: str) -> str | None:
        if not any(c in _DIGITS for c in text):
            return None
        if any(c.lower() not in _HEX for c in text):
            return self._places(text, "secret")
        new = self._places(text.lower(), "hex", _HEX)
        return new.upper() if text.upper() == text else new

    def email(self, text: str) -> str:
        local, at, domain = text.rpartition("@")
        return self._places(local, f"email/{domain.lower()}") + at + domain

    def iban(self, text: str) -> str | None:
        own = text.replace(" ", "")
        country, check, rest = own[:2], own[2:4], own[4:]
        if len(rest) < 11 or len(rest) > 30 or int(check) != _iban_check(country, rest):
            return None
        new = self._places(rest, f"iban/{country}")
        return _refill(text, _DIGITS + _LOWER.upper(), f"{country}{_iban_check(country, new):02d}{new}")

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        low = [{1: 0, 2: 10, 3: 100}[len(p)] for p in parts]
        high = [{1: 10, 2: 100, 3: 256}[len(p)] for p in parts]
        if any(not a <= int(p) < b for p, a, b in zip(parts, low, high)):
            return None
        value, size = 0, 1
        for p, a, b in zip(parts, low, high):
            value, size = value * (b - a) + int(p) - a, size * (b - a)
        value, new = self.feistel.below(value, size, f"ip/{[len(p) for p in parts]}"), []
        for a, b in reversed(list(zip(low, high))):
            value, d = divmod(value, b - a)
            new.append(str(d + a))
        return ".".join(reversed(new))

    def date(self, text: str) -> str | None:
        a, b, c = re.split(r"[-/.]", text)
        year_first = len(a) == 4
        orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)]
        for swapped, (y, m, d) in enumerate(orders):
            try:
                day = datetime.date(int(y), int(m), int(d))
            except ValueError:
                continue
            if not _FIRST_DAY <= day <= _LAST_DAY:
                return None

            def written(n: int) -> tuple[str, str, str]:
                new = _FIRST_DAY + datetime.timedelta(n)
                return str(new.year), str(new.month).zfill(len(m)), str(new.day).zfill(len(d))

            def fits(n: int) -> bool:
                _, mm, dd = written(n)
                return len(mm) == len(m) and len(dd) == len(d)

            n = self.feistel.below((day - _FIRST_DAY).days, (_LAST_DAY - _FIRST_DAY).days + 1,
                                   f"date/{len(m)}/{len(d)}", fits)
            yy, mm, dd = written(n)
            parts = (yy, mm, dd) if year_first else (mm, dd, yy) if swapped else (dd, mm, yy)
            return _refill(text, _DIGITS, "".join(parts))
        return None

    def phone(self, text: str) -> str:
        n = sum(c in _DIGITS for c in text)
        return self._digits(text, "phone", n - 10)

    def ssn(self, text: str) -> str | None:
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])

        def fits(v: int) -> bool:
            a, g, s = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return 0 < a < 900 and a != 666 and g > 0 and s > 0

        value = area * 1_000_000 + group * 10_000 + serial
        if not fits(value):
            return None
        new = f"{self.feistel.below(value, 10**9, 'ssn', fits):09d}"
        return f"{new[:3]}-{new[3:5]}-{new[5:]}"

    def card(self, text: str) -> str | None:
        own = "".join(c for c in text if c in _DIGITS)
        if luhn(own) or len(set(own)) == 1:
            return None
        body = f"{self.feistel.digits(int(own[:-1]), 10, len(own) - 1, f'card/{len(own)}'):0{len(own) - 1}d}"
        return _refill(text, _DIGITS, body + str(luhn(body + "0")))


_SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey")
_secret = re.compile(r"(?i)((?:password|passwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?)([0-9A-Za-z_\-]{12,})")
_email = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: How long the IBANs of a country are, where that is tried first.
_IBAN_SIZES = {c: n for n, some in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO HU LB PL",
    29: "BR QA UA", 30: "JO KW MU", 31: "MT SC"}.items() for c in some.split()}
#: A stretch that may hold numbers; the exact forms are looked for inside.
_stretch = re.compile(r"[0-9(+][0-9 .()/+-]{6,}")
_number = re.compile(
    r"(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]))"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}"
    r"|[0-9]{4}(?P<part>[ -])[0-9]{6}(?P=part)[0-9]{5})(?![0-9]))")


_forms = {k: re.compile(re.search(rf"\(\?P<{k}>.*?(?=\|\(\?P<(?:date|phone|ssn|card)>|$)", _number.pattern)[0])
          for k in ("ip", "date", "phone", "ssn", "card")}
_iso_time = re.compile(r"[Tt][0-9]{2}(?::?[0-9]{2})?")


def _iban_ends(text: str) -> list[int]:
    """Where an IBAN at the beginning of `text` may end: its country's length first, then ever shorter ones."""
    ends = [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] == " ")]
    own = _IBAN_SIZES.get(text[:2])
    return sorted(ends, key=lambda n: len(text[:n].replace(" ", "")) != own)


def _alone(text: str, kind: str, at: int, end: int) -> bool:
    """Whether no letter, digit or underscore is beside; the time of an ISO time stamp may follow a date."""
    after = text[end:end + 1]
    if kind == "date" and text[at:end][4:5] == "-" and _iso_time.match(text, end):
        after = ""
    return not any(c.isalnum() or c == "_" for c in (text[at - 1:at] if at else "") + after)


def pseudonymise(text: str | None, names: Pseudonyms, found: dict[str, int]) -> str | None:
    """The text with every validated value replaced; `found` counts them by kind."""
    if not text:
        return text

    done: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def put(kind: str, value: str, at: int) -> bool:
        end = at + len(value)
        if taken.find(1, at, end) >= 0:
            return False
        new = getattr(names, kind)(value)
        if new is not None:
            found[kind] = found.get(kind, 0) + 1
            done.append((at, end, new))
            taken[at:end] = b"\1" * (end - at)
        return new is not None

    low = text.lower()
    if any(w in low for w in _SECRET_WORDS):
        for m in _secret.finditer(text):
            put("secret", m[2], m.start(2))
    if "@" in text:
        for m in _email.finditer(text):
            put("email", m[0], m.start())
    m = _iban.search(text)
    while m:
        m = _iban.search(text, next((m.start() + n for n in _iban_ends(m[0]) if put("iban", m[0][:n], m.start())), m.start() + 1))
    for stretch in _stretch.finditer(text):
        body, first = stretch[0], stretch.start()
        m = _number.search(body)
        while m:
            # What fails its check may hide another form from here on, or a value that begins further right.
            forms = [(next(k for k in KINDS if m.groupdict().get(k)), m)]
            forms += [(k, other) for k, form in _forms.items() if k != forms[0][0] and (other := form.match(body, m.start()))]
            end = next((f.end() for kind, f in forms if _alone(text, kind, first + f.start(), first + f.end())
                        and put(kind, f[0], first + f.start())), m.start() + 1)
            m = _number.search(body, end)
    out, last = [], 0
    for a, b, new in sorted(done):
        out += [text[last:a], new]
        last = b
    return "".join(out) + text[last:]


def _replace(key: bytes, text_col: str, counts: dict[str, str] | None):
    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            out, found = [], []
            for text in batch.column(text_col).to_pylist():
                own: dict[str, int] = {}
                out.append(pseudonymise(text, names, own))
                found.append(own)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_col] = pa.array(out, pa.string())
            for kind, name in (counts or {}).items():
                columns[name] = pa.array([f.get(kind, 0) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text",
                          counts: dict[str, str] | None = None) -> DataFrame:
    """`docs` with `text_col` pseudonymised; `counts` maps kinds to the names of further columns with their numbers.

    Secrets, e-mail addresses, IBANs, IPv4 addresses, dates from 1900 to 2099, phone numbers, social security numbers and
    card numbers count, if they pass their checks (ranges, calendar, check digits) and no letter, digit or underscore is beside
    a number; of an ISO time stamp the date is replaced. What fails its check does not hide a value further right. Null and empty texts stay as they are, so
    do lengths, rows and other columns; repeated rows give equal rows. Nothing is shuffled."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields += [f"`{n}` long" for n in (counts or {}).values()]
    return docs.mapInArrow(_replace(key, text_col, counts), ", ".join(fields))


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the pseudonymised text and the number of values of each kind."""
    return replace_personal_data(docs.select("doc_id", "text"), key, counts={k: f"n_{k}" for k in KINDS})
