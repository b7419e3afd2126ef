"""Generated examples for the candidate models of ``pii``: (match, before, after, label) by generator."""

from __future__ import annotations

import random
import string

#: Syllables of four languages, for words that mean nothing.
SYLLABLES = ["ba", "the", "en", "ri", "tion", "lo", "sch", "heit", "ar", "un", "que", "os", "ment", "ción", "keit", "eau", "er", "an", "th", "ou"]
SECRET_NAMES = ["token", "api_key", "secret", "password", "auth key", "access token", "client_secret", "API_KEY", "passwd", "pwd", "credential", "secret key", "Password", "private_key"]
PHONE_NAMES = ["phone", "tel", "call", "mobile", "call me at", "my number is", "cell", "fax", "Telefon", "téléphone", "teléfono", "Tel.", "Handy", "reach us on", "ring", "contact"]
ID_NAMES = ["ssn", "SSN", "social security number", "passport", "passport no", "tax id", "Ausweis", "DNI", "national id", "insurance number", "driver license", "account number", "konto", "Passport No.", "passport number", "Personalausweis", "Reisepass Nr.", "NIE", "NIF", "passeport", "pasaporte", "driving licence", "identity card", "ID", "NINO", "national insurance"]
BIRTH_NAMES = ["born on", "born", "date of birth", "dob", "DOB", "geboren am", "né le", "née le", "nacido el", "birthday", "Geburtsdatum", "was born on", "geboren", "née", "nacida el", "geb.", "birth date"]
#: Months in four languages, with the word between day, month and year.
MONTHS = [(m, "") for m in ("January", "March", "May", "July", "October", "December", "Feb", "Sept", "mai", "août", "février", "juin", "März", "Juli", "Oktober", "Dezember")] + [(m, "de ") for m in ("enero", "mayo", "julio", "octubre")]
BANK_NAMES = ["IBAN", "iban", "account", "bank account", "Konto", "transfer to", "compte"]
PLACES = ["lives at", "address", "Adresse", "wohnt", "ship to", "home", "habite", "dirección", "visit us at"]


def word(rng: random.Random, most: int = 4) -> str:
    return "".join(rng.choices(SYLLABLES, k=rng.randrange(1, most + 1)))


def words(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


def digits(rng: random.Random, n: int) -> str:
    return drawn(rng, string.digits, n)


def drawn(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choices(letters, k=n))


def named(rng: random.Random, names: list[str]) -> str:
    """What stands before a thing that is called by its name."""
    return f"{words(rng, 2)} {rng.choice(names)}{rng.choice([' ', ': ', ' = ', ':', ' is ', '. ', ' - '])}"


def plain(rng: random.Random) -> str:
    return rng.choice([f"{words(rng, 3)} ", f"{words(rng, 2)}. ", "", f"{word(rng)}, ", f"{words(rng, 2)}: ", f"{word(rng)} ("])


def rest(rng: random.Random) -> str:
    return rng.choice([f" {words(rng, 2)}", ".", ", " + word(rng), "\n", "", ")"])


def _random_text(rng: random.Random) -> str:
    kinds = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"]
    return drawn(rng, rng.choice(kinds), rng.choice([16, 18, 20, 24, 32, 40, 64, 128, 300, 1000]))


def _assignment(rng: random.Random, names: list[str]) -> tuple[str, str]:
    quote = rng.choice(['"', "'", ""])
    return f"{word(rng)} {rng.choice(names)}{rng.choice([' = ', ': ', '=', ':', ' : '])}{quote}", quote or rng.choice([" ", "", "\n"])


def secret(rng: random.Random) -> tuple[str, str, str, int]:
    if rng.random() < 0.45:
        before, after = _assignment(rng, SECRET_NAMES)
        return _random_text(rng), before, after, 1
    kind = rng.randrange(7)
    if kind == 0:
        return drawn(rng, "0123456789abcdef", rng.choice([32, 40, 64])), plain(rng), rest(rng), 0
    if kind == 1:
        return "-".join(word(rng) for _ in range(6))[:60].ljust(16, "a"), f"{word(rng)} {rng.choice(SECRET_NAMES)} ", rest(rng), 0
    if kind == 2:
        return rng.choice("=-_") * rng.randrange(16, 60), rng.choice(["", plain(rng), named(rng, SECRET_NAMES)]), "\n", 0
    if kind == 3:
        return "".join(word(rng) for _ in range(8))[:40].ljust(16, "e"), f"{rng.choice([rng.choice(SECRET_NAMES), word(rng)])} ", rest(rng), 0
    if kind == 4:
        return digits(rng, rng.randrange(16, 22)), plain(rng), rest(rng), 0
    if kind == 5:
        return "/".join(word(rng) for _ in range(5)).ljust(16, "a"), rng.choice(["see ", "/", "http:/", words(rng, 2) + " "]), rest(rng), 0
    return "".join(word(rng) for _ in range(8)).upper()[:48].ljust(16, "E"), plain(rng), rng.choice(["!!", " ", "."]), 0


def assigned(rng: random.Random) -> tuple[str, str, str, int]:
    names = ["password", "passwd", "pwd", "secret", "token", "api key", "credential", "Password", "passphrase", "pw", "pass", "passcode", "PW", "Passwort", "Kennwort", "mot de passe", "contraseña"]
    before, after = _assignment(rng, names)
    if rng.random() < 0.35:
        before, after = f"{word(rng)} {rng.choice(names)} {rng.choice(['is', 'is', 'was', 'ist', 'est', 'es'])} ", rest(rng)
    kind = rng.randrange(8)
    if kind < 4:
        core = word(rng, 3)
        value = rng.choice([core + digits(rng, rng.randrange(1, 5)), core.title() + rng.choice("!#$%&") + digits(rng, 2), drawn(rng, string.ascii_letters + string.digits + "!#$%*?", rng.randrange(6, 16)), _random_text(rng), core + rng.choice("_-.") + word(rng) + digits(rng, 2)])
        return value, before, after, 1
    if kind == 4:
        return rng.choice(["null", "none", "None", "true", "false", "required", "****", "xxxx", "<password>", "{password}", "${TOKEN}", "********", "undefined"]), before, after, 0
    if kind == 5:
        return word(rng, 3).ljust(4, "e") + rng.choice(["", "", ".", "!", ")"]), f"{words(rng, 2)} {rng.choice(['password', 'token', 'secret', 'key', 'pass', 'pin'])} {rng.choice(['is', 'was', 'ist', 'est', 'es'])} ", rest(rng), 0
    return word(rng, 3).ljust(4, "e"), f"{words(rng, 2)} {rng.choice(['password', 'token', 'secret', 'key'])}: ", rest(rng), 0


def key(rng: random.Random) -> tuple[str, str, str, int]:
    both = string.ascii_letters + string.digits
    if rng.random() < 0.6:
        made = rng.choice(["AKIA" + drawn(rng, string.ascii_uppercase + string.digits, 16), "gh" + rng.choice("oprsu") + "_" + rng.choice([drawn(rng, both, 36), drawn(rng, string.ascii_lowercase + string.digits, 36)]), f"xoxb-{digits(rng, 11)}-{drawn(rng, both, 24)}", "sk-" + drawn(rng, both, 40), "AIza" + drawn(rng, both + "_-", 35), f"eyJ{drawn(rng, both, 20)}.{drawn(rng, both, 60)}.{drawn(rng, both, 40)}", "-----BEGIN RSA PRIVATE KEY-----", f"{rng.choice('rs')}k_{rng.choice(['live', 'test'])}_{drawn(rng, both, rng.choice([16, 24, 32, 40]))}", "github_pat_" + drawn(rng, both, 40), "glpat-" + drawn(rng, both, 20), "whsec_" + drawn(rng, both, 32), "npm_" + drawn(rng, both, 36), "hf_" + drawn(rng, both, 34), f"SG.{drawn(rng, both, 22)}.{drawn(rng, both, 43)}", "ya29." + drawn(rng, both + "_-", 60)])
        return made, rng.choice([plain(rng), named(rng, SECRET_NAMES), "aws "]), rest(rng), 1
    return rng.choice(["sk-" + "-".join(word(rng) for _ in range(8))[:40].ljust(20, "a"), "xoxb-" + "-".join(word(rng) for _ in range(4)).ljust(10, "a"), "eyJ" + "".join(word(rng) for _ in range(4)).ljust(8, "a") + "." + word(rng).ljust(4, "a")]), plain(rng), rest(rng), 0


def login(rng: random.Random) -> tuple[str, str, str, int]:
    user = rng.choice([word(rng), word(rng) + digits(rng, 2), "admin", "root", "postgres", ""])
    scheme = rng.choice(["postgres", "mysql", "https", "http", "ftp", "redis", "mongodb+srv", "amqp", "smb"])
    before, after = f"{words(rng, 2)} {scheme}://", f"@{word(rng)}.{rng.choice(['com', 'org', 'de', 'local'])}"
    if rng.random() < 0.65:
        secret = rng.choice([word(rng, 3).ljust(4, "e"), word(rng) + digits(rng, rng.randrange(1, 5)), word(rng).title() + rng.choice("!#$%&*") + digits(rng, 2), drawn(rng, string.ascii_letters + string.digits, rng.randrange(6, 40))])
        return f"{user}:{secret}", before, after, 1
    return rng.choice([f"{user}:{x}" for x in ("****", "<password>", "{password}", "${PASSWORD}", "password", "pass", "%s", "[secret]", "xxxx", "secret")] + ["${USER}:${PASS}", "{user}:{pw}"]), before, after, 0


def identity(rng: random.Random) -> tuple[str, str, str, int]:
    up = string.ascii_uppercase
    made = [f"{drawn(rng, up, rng.randrange(1, 4))}{digits(rng, rng.randrange(6, 10))}", f"{drawn(rng, up, 2)}{digits(rng, 6)}{rng.choice('ABCD')}", f"{digits(rng, 8)}{rng.choice(['', '-'])}{rng.choice(up)}", f"{rng.choice('XYZ')}{digits(rng, 7)}{rng.choice(['', '-'])}{rng.choice(up)}", f"{drawn(rng, up, 2)} {digits(rng, 2)} {digits(rng, 2)} {digits(rng, 2)} {rng.choice('ABCD')}", f"{rng.choice('CFGHJKL')}{drawn(rng, 'CFGHJKLMNPRTVWXYZ0123456789', 7)}{digits(rng, 1)}"]
    if rng.random() < 0.5:
        return rng.choice(made), named(rng, ID_NAMES), rest(rng), 1
    return rng.choice([*made, f"{drawn(rng, up, 3)} {digits(rng, 5)}", f"{drawn(rng, up, 2)}-{digits(rng, 5)}"]), rng.choice([plain(rng), plain(rng), named(rng, ["model", "part", "order", "ref", "version", "room", "flight", "type", "item", "code", "invoice"])]), rest(rng), 0


def iban(rng: random.Random) -> tuple[str, str, str, int]:
    country, body = rng.choice([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14), ("IT", 23)]), ""
    body = ("" if country[0] in ("DE", "ES") else drawn(rng, string.ascii_uppercase, 4)) + digits(rng, country[1])
    body = body[: country[1]]
    number = "".join(str(int(c, 36)) for c in body + country[0]) + "00"
    right = rng.random() < 0.5
    check = 98 - int(number) % 97 if right else rng.randrange(2, 99)
    right = right or check == 98 - int(number) % 97
    made = f"{country[0]}{check:02d}{body}"
    if rng.random() < 0.5:
        made = " ".join(made[i : i + 4] for i in range(0, len(made), 4))
    if not right and rng.random() < 0.5:
        made = f"{drawn(rng, string.ascii_uppercase, 2)}{digits(rng, 2)} {drawn(rng, string.ascii_uppercase, 4)} {drawn(rng, string.ascii_uppercase + string.digits, 4)}"
    return made, rng.choice([plain(rng), named(rng, BANK_NAMES)]), rest(rng), int(right)


def number(rng: random.Random) -> tuple[str, str, str, int]:
    d = lambda n: digits(rng, n)
    phones = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{rng.randrange(1, 10)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{rng.randrange(1, 10)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"0{d(4)}/{d(6)}", f"0{d(3)}-{d(7)}", f"{rng.randrange(6, 10)}{d(2)} {d(3)} {d(3)}", f"{rng.randrange(6, 10)}{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}"]
    sure = [phones[i] for i in (0, 1, 3, 4, 5, 6, 7, 8)]
    kind = rng.randrange(12)
    if kind < 4:
        return rng.choice(phones), named(rng, PHONE_NAMES), rest(rng), 1
    if kind == 4:
        return rng.choice(sure), plain(rng), rest(rng), 1
    if kind == 5:
        return f"{d(3)}-{d(2)}-{d(4)}", rng.choice([plain(rng), plain(rng), named(rng, ID_NAMES), named(rng, ID_NAMES)]), rest(rng), 1
    if kind == 6:
        return rng.choice([f"{d(3)} {d(2)} {d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)}-{d(6)}", f"{d(4)} {d(4)} {d(2)}"]), named(rng, ID_NAMES), rest(rng), 1
    no = [f"{d(2)}.{d(2)}.{rng.randrange(1900, 2040)}", f"{rng.randrange(1900, 2040)}-{d(2)}-{d(2)}", f"{rng.randrange(1, 9)}.{d(2)}", f"{rng.randrange(1, 30)}.{rng.randrange(1, 30)}.{rng.randrange(1, 30)}", f"{rng.randrange(1900, 2040)}-{rng.randrange(1900, 2040)}", f"{rng.randrange(1, 99)} / {rng.randrange(1, 99)}", " ".join(str(rng.randrange(1, 1000)) for _ in range(rng.randrange(2, 9))), f"{rng.randrange(1, 999)} {d(3)}", f"{rng.randrange(1, 999)}.{d(3)}.{d(3)}", f"{d(1)}-{d(1)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)}.{d(2)}.{d(3)}.{d(3)}", f"{d(2)}.{d(3)}.{d(3)}.{d(2)}", f"{d(2)}-{d(2)}", f"{d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]
    before = rng.choice([plain(rng), f"{words(rng, 2)} {d(3)} ", named(rng, ["price", "version", "page", "score", "year", "room", "total", "order", "chapter"])])
    return rng.choice(no), before, rest(rng), 0


def run_of_digits(rng: random.Random) -> tuple[str, str, str, int]:
    kind = rng.randrange(6)
    if kind < 2:
        return digits(rng, rng.randrange(8, 13)), named(rng, ID_NAMES), rest(rng), 1
    if kind == 2:
        return f"0{digits(rng, rng.randrange(8, 11))}", named(rng, PHONE_NAMES), rest(rng), 1
    return digits(rng, rng.randrange(7, 20)), rng.choice([plain(rng), named(rng, ["count", "page", "id", "order", "views", "population", "total", "bytes", "timestamp"])]), rest(rng), 0


def ipv6(rng: random.Random) -> tuple[str, str, str, int]:
    h = lambda: f"{rng.randrange(65536):x}"
    if rng.random() < 0.5:
        return rng.choice([":".join(h() for _ in range(8)), f"{rng.choice(['2001', 'fe80', '2a02', 'fd00'])}:{h()}::{h()}", f"{rng.choice(['2001', 'fe80'])}::{h()}:{h()}:{h()}:{h()}", f"{rng.choice(['2001', '2a00', 'fd12', '2606'])}:{h()}::{rng.randrange(1, 16):x}", f"{rng.choice(['2001', '2a00', '2606'])}:{h()}:{h()}::{rng.choice(['', h()])}", f"{rng.choice(['fe80', 'fd00', '2001'])}::{rng.randrange(1, 256):x}"]), plain(rng), rest(rng), 1
    d = lambda: f"{rng.randrange(60):02d}"
    return rng.choice([f"{d()}:{d()}:{d()}", "::", f"{rng.randrange(9)}:{d()}:", "a::", "::b", f"{rng.randrange(1, 9)}:{rng.randrange(1, 9)}:{rng.randrange(1, 9)}", ":::"]), plain(rng), rest(rng), 0


def mail(rng: random.Random) -> tuple[str, str, str, int]:
    at, dot = rng.choice([" at ", " [at] ", "(at)", " (at) ", "[at]", " AT ", " @ "]), rng.choice([" dot ", " [dot] ", "(dot)", " (dot) ", " DOT "])
    host = f"{word(rng)}{rng.choice([dot, dot, '.'])}{rng.choice(['com', 'org', 'de', 'fr', 'es', 'net', 'io', 'co', 'edu'])}"
    if rng.random() < 0.5:
        return f"{word(rng)}{rng.choice(['', '', '.', '_'])}{rng.choice(['', word(rng)])}{at}{host}", rng.choice([plain(rng), named(rng, ["mail", "email", "e-mail", "contact", "write to"])]), rest(rng), 1
    return rng.choice([f"{word(rng)} at {word(rng)}.{word(rng).title()}", f"{word(rng)} at {word(rng)} point {word(rng)}", f"{word(rng)} at the dot {word(rng)}", f"{word(rng)} at {digits(rng, 2)}.{digits(rng, 2)}"]), plain(rng), rest(rng), 0


def address(rng: random.Random) -> tuple[str, str, str, int]:
    n, name = str(rng.randrange(1, 2000)), word(rng).title()
    good = [f"{n} {name} {rng.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Boulevard', 'Court', 'St', 'Ave', 'Rd'])}", f"{name}{rng.choice(['straße', 'strasse', 'weg', 'platz', 'allee'])} {rng.randrange(1, 300)}", f"{n} rue de {name}", f"Calle {name} {rng.randrange(1, 300)}", f"{n}, avenue {word(rng)}"]
    if rng.random() < 0.55:
        return rng.choice(good), rng.choice([plain(rng), named(rng, PLACES)]), rest(rng), 1
    return rng.choice([f"{n} {name} Way", f"{name}weg {rng.randrange(1900, 2040)}", f"{n} place {word(rng)}", f"{n} {name} Court", f"plaza {word(rng)} {n}"]), f"{words(rng, 2)} {rng.choice(['in', 'of', 'page', 'the', 'won'])} ", rest(rng), 0


def date(rng: random.Random) -> tuple[str, str, str, int]:
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1900, 2030)
    made = rng.choice([f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d}", f"{month}/{day}/{year}", f"{day}.{month}.{year % 100:02d}", f"{day}/{month}/{year}"])
    if rng.random() < 0.5:
        month, of = rng.choice(MONTHS)
        made = rng.choice([f"{day} {of}{month} {of}{year}", f"{day}. {month} {year}", f"{month} {day}, {year}", f"{month} {day} {year}", f"{day}{'st' if day == 1 else 'th'} of {month} {year}", f"{month} {day}{'st' if day == 1 else 'th'}, {year}"])
    born = rng.random() < 0.5
    return made, named(rng, BIRTH_NAMES) if born else rng.choice([plain(rng), named(rng, ["on", "since", "published", "dated", "version", "until", "le", "am", "updated"])]), rest(rng), int(born)


EXAMPLES = {"secret": secret, "assigned": assigned, "key": key, "login": login, "iban": iban, "number": number, "digits": run_of_digits, "identity": identity, "ipv6": ipv6, "mail": mail, "address": address, "date": date}
