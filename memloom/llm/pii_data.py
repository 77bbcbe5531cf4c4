"""Labelled spans for the personal-information tagger.

Every training text is built from an unlabelled carrier text (rows of the
``episodes``/``handoffs`` tables that show no personal data) into which
sentences holding generated values are inserted, so the character span of
every value is known exactly.  Names, addresses and numbers are invented.
"""

from __future__ import annotations

import random
import re
import string

TYPES = ("email", "phone", "id_number", "address", "person_name")

#: Common given names of many languages (fixed values, natural order).
GIVEN = (
    "Aaron Abdul Adela Agnes Ahmed Aisha Alan Albert Alejandra Alex Alice Amelie Amina Andrea Anita Anna Anton Arjun Astrid Barbara Beatriz Ben Bernd Bianca Boris Brigitte Camille Carlos Carmen "
    "Catherine Cem Charlotte Chen Chloe Christoph Claire Clara Daniel David Deborah Diego Dimitri Dora Edward Elena Elif Elsa Emil Emma Enrique Erik Esther Eva Fatima Felix Fernando Fiona Florian "
    "Francesca Frank Freya Gabriel George Giulia Grace Greta Guillaume Gustav Hannah Harold Hassan Heike Helen Henrik Hiroshi Hugo Ibrahim Ingrid Irene Isabel Ivan Jack Jakub James Jana Javier Jean "
    "Jens Joanna John Jonas Jorge Josephine Juan Julia Karim Karl Katarina Kenji Klaus Lars Laura Leila Leo Lena Linda Louis Lucia Lukas Magda Manuel Marco Margaret Maria Marie Martin Mateo Matthias "
    "Maya Mehmet Michael Mira Mohammed Monique Nadia Natalia Nathan Nicolas Nils Nora Oliver Olga Omar Oscar Pablo Patrick Paul Pedro Petra Philippe Priya Rachel Raj Rebecca Ricardo Robert Rosa Ruth"
).split()
#: Common family names of many languages (fixed values, natural order).
FAMILY = (
    "Adams Almeida Andersson Bailey Baker Bauer Becker Bernard Bianchi Brown Campbell Carter Castro Chang Clark Cohen Cooper Costa Delgado Dubois Dupont Edwards Evans Fernandez Ferrari Fischer "
    "Fontaine Foster Garcia Gomez Gonzalez Graham Gupta Haas Hansen Harris Hernandez Hoffmann Hughes Ivanov Jackson Jansen Johnson Kaya Keller Khan Kim Klein Kowalski Kumar Lambert Larsen Lee Lefebvre "
    "Lopez Martin Mendoza Meyer Miller Moreau Morris Murphy Nakamura Nguyen Novak Okafor Ortiz Patel Pereira Peterson Petrov Ramirez Richter Rivera Roberts Romano Rossi Roux Ruiz Sanchez Santos Schmidt "
    "Schneider Silva Singh Smith Suzuki Tanaka Taylor Thompson Torres Turner Vargas Vogel Wagner Walker Wang Weber White Williams Wilson Wolf Wright Yamamoto Yilmaz Young Zhang Zimmermann"
).split()
#: Parts of made-up family, street and town names (fixed values).
STEMS = "Ald Bar Bel Bren Cal Cor Dal Dor Eld Fal Fen Gar Gold Hal Hart Hol Kel Kin Lan Lar Mal Mar Mel Nor Oak Per Quin Ral Ros Sal San Sel Stan Tam Tor Ul Val Ven Wal Wen Wil Yar Zel".split()
ENDS = "a ano berg berry by croft dale den eck ell en enne er eska ez feld field ford gate ham hurst i imov ing ino ley ling low man mann mere o ock off ora oru ova ow ski son stad stead ston ton us well wick wood worth".split()
PLACES = "Abbey Acorn Apple Ash Bank Beech Bell Birch Bridge Brook Castle Cedar Cherry Church Clay Copper Elm Falcon Fern Field Forest Fox Garden Grange Green Hawthorn Hazel High Hill Holly Ivy Juniper Kings Lake Laurel Lime Linden Main Manor Maple Market Meadow Mill Moor North Oak Orchard Park Pine Pond Poplar Priory Queens Quarry Ridge River Rose School Sea Second South Spring Station Stone Sycamore Third Vale Valley Vine West Willow Wood".split()
KINDS = "Street|Street|St|St.|Road|Road|Rd|Rd.|Lane|Lane|Ln|Avenue|Avenue|Ave|Ave.|Drive|Dr|Court|Ct|Close|Terrace|Way|Place|Square|Boulevard|Blvd|Crescent|Row|Gardens".split("|")
TOWNS = "Aachen|Albany|Alicante|Amsterdam|Austin|Barcelona|Basel|Berlin|Bern|Bilbao|Bordeaux|Boston|Bristol|Bruges|Cardiff|Chicago|Cork|Dallas|Denver|Dresden|Dublin|Essen|Frankfurt|Geneva|Graz|Hamburg|Houston|Leeds|Lille|Lisbon|London|Lyon|Madrid|Málaga|Manchester|Miami|Milan|Munich|Nantes|New York|Nice|Oslo|Oxford|Paris|Portland|Porto|Prague|Rennes|Rome|Salzburg|San Diego|Santa Cruz|Saint-Denis|Seattle|Sevilla|Stuttgart|Toledo|Toulouse|Turin|Valencia|Vienna|York|Zaragoza".split("|")
DE_PARTS, DE_KINDS = "Ahorn Bach Bahnhof Berg Birken Brunnen Burg Dorf Eichen Feld Garten Goethe Haupt Kirch Kloster Linden Mühl Nord Park Post Ring Rosen Schiller Schloss Schul Sonnen Tannen Wald Wiesen Ziegel".split(), "straße|straße|str.|weg|gasse|allee|platz|ring|hof".split("|")
FR_KINDS, FR_PARTS = "rue|rue|rue|avenue|boulevard|place|chemin|allée|impasse".split("|"), "de la Paix|des Lilas|Victor Hugo|de la République|du Marché|Pasteur|des Écoles|du Château|de Verdun|Voltaire|des Roses|de l'Église|du Port|des Cerisiers|Gambetta|du Lac|des Prés".split("|")
ES_KINDS, ES_PARTS = "Calle|Calle|C/|Avenida|Avda.|Plaza|Paseo|Camino|Travesía".split("|"), "de Alcalá|del Carmen|de la Rosa|de los Pinos|San Juan|Santa Ana|de Goya|del Río|de la Fuente|Cervantes|de las Flores|Real|del Castillo|de Colón|de la Luna".split("|")
MAIL_WORDS = "mail post inbox office corp home web net work team labs cloud data group media north blue river stone alpha delta nova".split()
MAIL_ENDS = "com com com org org net net de fr es it uk co.uk io eu edu info example test invalid ch at".split()

CARRIERS = {
    "email": "Send it to {}.|My address is {}.|You can write to {} any time.|{} replied twice.|Forward the file to {} please.|Contact: {}|E-mail: {}|mail me: {}|From {} we got nothing.|Bitte an {} schicken.|Schreib mir an {}.|Meine Adresse lautet {}.|Manda el informe a {}.|Mi correo es {}.|Envoyez-le à {}.|Mon adresse est {}.|Contacter {} en cas de panne.|cc: {}|The user {} reported it|reach out to {} or wait|The invoice went from {} to the wrong inbox.|({})|{}",
    "phone": "Call me at {}.|My number is {}.|Phone: {}|You can ring {} after six.|Tel. {}|Her mobile is {}.|Dial {} and ask for support.|Reach the desk on {}.|WhatsApp {}|Telefon: {}|Meine Nummer ist {}.|Ruf mich unter {} an.|Handy {}|Mi número es {}.|Llámame al {}.|Teléfono {}|Mon numéro est le {}.|Appelez le {}.|Tél. : {}|Fax: {}|They left {} on the machine.|Try {} first, then the desk.|({})|{}",
    "id_number": "He gave {} as proof.|{} is on the form.|Customer with {} called.|I entered {} twice.|{}|Her {} was rejected.|My {}.|The record shows {}.|Copy of {} attached.|Sie nannte {}.|Angegeben wurde {}.|Mit {} angemeldet.|Presenta {}.|Consta {}.|Avec {} au dossier.|Elle a fourni {}.|We stored {} by mistake.|Please check {} again.",
    "address": "I live at {}.|Her house is at {}.|Send the parcel to {}.|The office moved to {}.|Address: {}|Meet at {} tomorrow.|We shipped the router to {} last week.|Home: {}|Located at {}.|Ich wohne {}.|Wir wohnen in der {}.|Adresse: {}|Das Paket ging an {}.|Vivo en {}.|La oficina está en {}.|Dirección: {}|J'habite {}.|Le colis part au {}.|Adresse : {}|The technician drove to {} twice.|{}|Return it to {} please.",
    "person_name": "{} called this morning.|I talked to {} yesterday.|Ask {} about the plan.|{} will join the meeting.|The report was written by {}.|{} said that it works.|Please tell {} that we are late.|My name is {}.|This is {} speaking.|Best regards, {}|Cheers, {}|Meeting with {} at noon.|{} and {2} agreed.|Can {} look at it?|{}'s laptop was replaced.|Ich habe {} gefragt.|{} kommt später.|Laut {} ist alles gut.|Viele Grüße, {}|{} llamó ayer.|Pregunta a {}.|Según {}, todo va bien.|Saludos, {}|{} a appelé hier.|Demandez à {}.|Selon {}, tout va bien.|Cordialement, {}|contact {} first|Dear {},|Hi {}, thanks for the update.|Owner: {}|Author: {}|The patient {} was moved.|{} signed the lease.|{} hat unterschrieben.",
}

#: Words of which name sentences are put together (fixed values).
BEFORE = "asked|thanked|invited|met|told|called|paid|trusts|knows|replaced|helped|signed by|written by|found by|owned by|sent to|from|with|for|and|via|per|versprach|fragte|traf|dankte|von|mit|für|und|llamó a|vio a|con|de|para|y|avisó a|avec|par|pour|et|chez|appela|vit|remercia".split("|")
AFTER = "asked|found|fixed|left|wrote|moved|wants|thinks|signed|reported|closed|opened|paid|is|was|has|will|can|for|to|about|that|on|at|and|hat|ist|war|schrieb|fand|will|kam|dass|wegen|sobre|que|ha|es|fue|quiere|dijo|para|a|est|était|veut|dit|pour|sur".split("|")

#: Words that stand where a person might and are none.
ROLES = "planner|scheduler|router|indexer|the archivist|the on-call engineer|operations|the vendor|support|the auditor|backup agent|the dispatcher|release team|finance|the night shift|our customer|the reviewer|gateway|crawler|the night operator|billing agent|the courier".split("|")
TITLES = "Project|Operation|Sprint|Release|Service|Cluster|Node|Team|Room|Queue|Ticket|Build|Milestone|Epic|Plan".split("|")
NEAR_MISSES = (
    "@{w}.{w} is a decorator.|ping @{w}-bot about it.|The image {w}/{w}@sha256:{h13} was rebuilt.|Host 10.{d2}.{d2}.{d3} answered on port {d4}.|{T} {W} {W} is on track.|{T} {W} slipped by {d1} days.|"
    "Version {d1}.{d2}.{d1} came out on 20{d2}-0{d1}-1{d1}.|Checksum {h10} is right.|0x{h7} at line {d4} of {w}.py.|Machine {w}-{d3} restarted {d1} times.|Ticket #{d9} is closed.|Part {d2}-{d4}-{d3} fits.|SKU {d5} costs {d2}.99.|"
    "Invoice {d4} is in the archive.|Order {d3}-{d7} ships today.|We processed {d6} rows in {d3} seconds.|From {d2}:{d2} to {d2}:{d2} nothing happened.|Page {d3} of {d3}|Rechnung {d5} vom 1{d1}.0{d1}.20{d2}.|commit {h10}{h7}|trace {h13}|case {d10} - done|"
    "INC0{d9} was merged into INC0{d9}.|job {d9} and run-{h8} ended.|{R} asked {R} for help.|{R} replied within the hour.|Spoke with {R}.|Approved by {R}.|Assigned to {R}.|https://{w}.example/{w}/{d5}|see {w}.{w}.com/{w}|{W} {W} moves to lane {d2}.|# {W} {W}\n|{W} and {W} differ.|It was 20{d2}-0{d1}-2{d1} and {W} was full.|0{d1}.1{d1}.20{d2}|between 1{d1}:{d2} and 2{d1}:{d2} the {w} was slow|The range 172.{d2}.{d2}.0/{d2} and 192.{d3}.{d1}.{d2} are taken.|{d1} {d3} {w} and {d2} {w}|{d1},{d3},{d3} {w} in {d2} {w}|a las {d2}:{d2} {w} {w} {w}|um {d2}:{d2} Uhr {w} {w}|{d3} {w} et {d2} {w}|{w} {d4} und {w} {d2}|the {w} was {w} at eight|{W} {w}, {w} {w} {w}.|{W} {w} {w} {w}|{w} {w} {d4}-{d4} {w}|The {W} {W} was late."
).split("|")


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _made(r: random.Random) -> str:
    return r.choice(STEMS) + r.choice(ENDS)


def _surname(r: random.Random) -> str:
    k = r.random()
    if k < 0.3:
        return _made(r)
    if k < 0.42:
        syl = [a + b for a in "bcdfghjklmnprstvwz" for b in ("a", "e", "i", "o", "u", "ar", "en", "il", "os")]
        return "".join(r.choice(syl) for _ in range(r.choice((2, 3)))).capitalize()
    s = r.choice(FAMILY)
    if k < 0.5:
        s = r.choice(["O'", "Mc", "van ", "de ", "von ", "al-", "De", "Mac"]) + s
    return s if r.random() > 0.06 else f"{s}-{r.choice(FAMILY)}"


def _given(r: random.Random) -> str:
    return r.choice(GIVEN) if r.random() < 0.85 else "".join(r.choice("bdfjklmnrstvyz") + r.choice(("a", "e", "i", "o", "u", "ia", "an", "el", "in")) for _ in range(r.choice((2, 2, 3)))).capitalize()


def name(r: random.Random) -> str:
    g, s = _given(r), _surname(r)
    out = r.choice(
        [f"{g} {s}"] * 6
        + [g, g, f"{s}, {g}", f"{g[0]}. {s}", f"{g} {r.choice(string.ascii_uppercase)}. {s}", f"{g} {_given(r)} {s}", f"Dr. {g} {s}", f"Dr. {s}", f"Mr. {s}", f"Mr {s}", f"Ms {s}", f"Mrs. {s}", s, f"Herr {s}", f"Frau {s}", f"Señora {s}", f"M. {s}", f"Mme {s}", f"Prof. {s}"]
    )
    k = r.random()
    return out.lower() if k < 0.12 else out.upper() if k < 0.24 else out


def email(r: random.Random) -> str:
    g, s = re.sub(r"\W", "", _given(r)).lower(), re.sub(r"\W", "", _surname(r)).lower()
    dom = r.choice([f"{r.choice(MAIL_WORDS)}", f"{r.choice(MAIL_WORDS)}-{r.choice(MAIL_WORDS)}", f"{r.choice(MAIL_WORDS)}{r.choice(MAIL_WORDS)}", f"{r.choice(MAIL_WORDS)}.{r.choice(MAIL_WORDS)}", _made(r).lower(), "example", "example"]) + "." + r.choice(MAIL_ENDS)
    local = r.choice([f"{g}.{s}", f"{g}.{s}", f"{g}{_d(r, 2)}", f"{g}{_d(r, 1)}", f"{g[0]}{s}", f"{s}_{g}+{r.choice(MAIL_WORDS)}", f"{g}-{s}", f"{s}.{g}", f"{g}_{s}{_d(r, 2)}", g, s, f"{g[0]}.{s}"])
    k = r.random()
    if k < 0.6:
        out = f"{local}@{dom}"
    elif k < 0.7:
        out = f"{local} [at] {dom.replace('.', ' dot ')}"
    elif k < 0.8:
        out = f"{local}(at){dom}"
    elif k < 0.87:
        out = f"{local.replace('.', ' dot ')} [at] {dom.replace('.', ' dot ')}"
    elif k < 0.93:
        out = f"{local.replace('.', ' (dot) ')} at {dom.replace('.', ' (dot) ')}"
    else:
        out = f"{local} at {dom.replace('.', ' dot ')}"
    if r.random() < 0.15:
        out = out.upper()
    return r.choice(["{}"] * 8 + ["<{}>", "<{}>", "mailto:{}", "mailto:{}"]).format(out)


def phone(r: random.Random) -> str:
    if r.random() < 0.6:
        shape = r.choice(
            "+1 ddd ddd dddd|1-ddd-ddd-dddd|ddd.ddd.dddd|(ddd) ddd-dddd|ddd-ddd-dddd|ddd ddd dddd|+44 7ddd dddddd|020 dddd dddd|0044ddddddddd|00ddddddddddd|+44 (0)dddd ddd ddd|+33 d dd dd dd dd|0d.dd.dd.dd.dd|0d dd dd dd dd|"
            "+49-dd-ddddd-ddd|0dd ddddd ddd|0dd/ddddddd|(0d) dddd dddd|+49 dd ddddd ddd|+49 ddd ddddddd|+34 ddd ddd ddd|ddd dd dd dd|+86 dd dddd dddd|0ddd ddd ddd|+dd dddddddddd|0ddd dddddd|0ddddddddddd".split("|")
        )
        return re.sub("d", lambda _: _d(r, 1), shape)
    sep = r.choice(" -.")
    parts = [_d(r, r.choice((2, 3, 3, 4))) for _ in range(r.choice((3, 3, 4)))]
    while sum(map(len, parts)) < 8:
        parts.append(_d(r, 2))
    return r.choice(["", "", "+", "0", "00"]) + sep.join(parts)


def id_number(r: random.Random) -> str:
    up = string.ascii_uppercase
    a = lambda: r.choice(up)
    g = lambda *n: r.choice(" -") .join(_d(r, k) for k in n)
    kinds = [
        (["SSN", "ssn", "social security number", "Social security number", "social security no.", "tax id", "Tax ID", "TIN", "ITIN"], [f"{_d(r, 3)}-{_d(r, 2)}-{_d(r, 4)}", f"{_d(r, 3)} {_d(r, 2)} {_d(r, 4)}"]),
        (["national insurance", "National insurance", "national insurance number", "NINO", "NI number"], [f"{a()}{a()} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {r.choice('ABCD')}", f"{a()}{a()}{_d(r, 6)}{r.choice('ABCD')}"]),
        (["passport", "Passport", "passport no.", "passport number", "Reisepass", "passeport", "pasaporte", "Passnummer", "Pasaporte"], [f"{a()}{a()}{_d(r, 7)}", f"{a()}{_d(r, 8)}", f"{_d(r, 2)}{a()}{a()}{_d(r, 5)}", f"{a()}{a()}{a()}{_d(r, 6)}", _d(r, 9)]),
        (["driving licence", "Driving licence", "driver's license", "driver license", "licence no.", "Führerschein", "permis", "carnet"], [f"{a()}{_d(r, 3)}-{_d(r, 4)}-{_d(r, 4)}", f"{a()}{_d(r, 7)}", f"{a()}{_d(r, 2)}{a()}{_d(r, 5)}"]),
        (["DNI", "NIE", "NIF", "dni"], [f"{_d(r, 8)}{a()}", f"{_d(r, 8)}-{a()}", f"{r.choice('XYZ')}{_d(r, 7)}{a()}"]),
        (["Steuer-ID", "Steuernummer", "Steuer-Identifikationsnummer"], [f"{_d(r, 2)} {_d(r, 3)} {_d(r, 3)} {_d(r, 3)}", _d(r, 11)]),
        (["Ausweisnummer", "Personalausweis", "Ausweis Nr.", "ID card", "identity card", "identity number", "carte d'identité", "ID number"], [f"{a()}{_d(r, 3)}{a()}{_d(r, 4)}{a()}", f"{a()}{_d(r, 8)}", f"{_d(r, 12)}", f"{a()}{a()}{_d(r, 6)}"]),
        (["numéro de sécurité sociale", "Numéro de sécurité sociale", "numéro INSEE"], [f"{_d(r, 1)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {_d(r, 3)} {_d(r, 3)} {_d(r, 2)}", _d(r, 15)]),
    ]
    labels, values = r.choice(kinds)
    k = r.random()
    if k < 0.06:
        return f"{_d(r, 3)}-{_d(r, 2)}-{_d(r, 4)}"
    return f"{r.choice(labels)}{r.choice([' '] * 8 + [': ', ' is ', ' # ', ' no. ', '='])}{r.choice(values)}"


def address(r: random.Random) -> str:
    n, town = str(r.randint(1, 250)), r.choice(TOWNS) if r.random() < 0.6 else r.choice(["", "", "Port ", "Saint-", "San ", "New "]) + _made(r)
    st = r.choice([r.choice(PLACES), f"{r.choice(PLACES)} {r.choice(PLACES)}", _made(r), f"{r.choice(['Old', 'New', 'Upper', 'Little'])} {r.choice(PLACES)}"])
    kd, zip5 = r.choice(KINDS), _d(r, 5)
    k = r.random()
    if k < 0.58:
        out = r.choice(
            [
                f"{n} {st} {kd}, {town}", f"{n} {st} {kd}, {town}", f"{n} {st} {kd}", f"{n}-{int(n) + 2} {st} {kd}\n{town}", f"Apt {r.randint(1, 9)}{r.choice('ABC')}, {n} {st} {kd}, {town}", f"{n} {st} {kd} Apt {r.randint(1, 99)}, {town}",
                f"Flat {r.randint(1, 28)}, {n} {st} {kd}, {town} {zip5}", f"P.O. Box {n}, {town}", f"PO Box {_d(r, 4)}, {town}", f"{n} {st} {kd}, {town} {zip5}", f"{n}{r.choice('AB')} {st} {kd}, {town}", f"{n} {st} {kd}, {town}, {r.choice('ACILMNOTV')}{r.choice('AKLNTXY')} {zip5}",
                f"Unit {r.randint(1, 40)}, {n} {st} {kd}, {town}",
            ]
        )
        if r.random() < 0.18:
            out = out.lower()
    elif k < 0.74:
        s = r.choice([r.choice(DE_PARTS) + r.choice(DE_KINDS), f"Am {r.choice(DE_PARTS)}{r.choice(['hof', 'graben', 'tor', 'see'])}", f"Alte {r.choice(DE_PARTS)}straße", f"{_made(r)}er Straße", "Am Markt"])
        out = r.choice([f"{s} {n}, {zip5} {town}", f"{s} {n}{r.choice('abc')}, {town}", f"{s} {n}, {town}", f"{s} {n}, D-{zip5} {town}", f"{s} {n}"])
    elif k < 0.88:
        s = f"{r.choice(FR_KINDS)} {r.choice(FR_PARTS) if r.random() < 0.6 else r.choice(['', 'du ', 'des ', 'de la ']) + _made(r)}"
        out = r.choice([f"{n} {s}, {zip5} {town}", f"{n} bis, {s}, {town}", f"{n}, {s}, {zip5} {town}", f"{n} {s}, {town}"])
    else:
        s = f"{r.choice(ES_KINDS)} {r.choice(ES_PARTS) if r.random() < 0.6 else r.choice(['', 'del ', 'de la ', 'de los ']) + _made(r)}"
        out = r.choice([f"{s} {n}, 3º B, {town}", f"{s}, {n}, {town}", f"{s} {n}, {zip5} {town}", f"{s}, {n}, {r.randint(1, 9)}º {r.choice('ABCD')}, {zip5} {town}", f"{s} {n}"])
    return out


MAKERS = {"email": email, "phone": phone, "id_number": id_number, "address": address, "person_name": name}


def value(r: random.Random, kind: str) -> str:
    return MAKERS[kind](r)


def near_miss(r: random.Random, background: str = "") -> str:
    """A sentence that resembles personal data and is none; its words are those of the background."""
    ws = [w for w in re.findall(r"[A-Za-z]{3,}", background)] or ["notes", "stone", "harbor"]
    fill = {"w": lambda: r.choice(ws).lower(), "W": lambda: r.choice(ws).capitalize(), "T": lambda: r.choice(TITLES), "R": lambda: r.choice(ROLES)}
    s = re.sub(r"\{([wWTR])\}", lambda m: fill[m[1]](), r.choice(NEAR_MISSES))
    s = re.sub(r"\{([dh])(\d+)\}", lambda m: _d(r, int(m[2])) if m[1] == "d" else "".join(r.choice("0123456789abcdef") for _ in range(int(m[2]))), s)
    return s[:1].upper() + s[1:] if r.random() < 0.7 else s


def heading(r: random.Random, background: str) -> str:
    """A heading of words of the background, as in marked-up notes."""
    ws = [w for w in re.findall(r"[A-Za-z]{3,}", background)] or ["Notes"]
    t = " ".join(r.choice(ws).capitalize() for _ in range(r.choice((1, 2, 2, 3))))
    return r.choice([f"\n# {t}\n", f"\n\n## {t}\n", f"\n\n### {t}\n", f"**{t}**", f"{t}\n", f"- {t}:"])


def labelled_text(r: random.Random, background: str) -> tuple[str, list[tuple[int, int, str]]]:
    """One text with the spans (start, end, type) of its inserted values."""
    sents = [s for s in re.split(r"(?<=[.!?。])\s+|(?<=\n)", background) if s.strip()] or [""]
    parts: list[tuple[str, str | None, str]] = [(s, None, "") for s in r.sample(sents, min(len(sents), r.choice((0, 1, 1, 2, 3))))]
    for _ in range(r.choice((0, 1, 1, 1, 2, 2, 3))):
        kind = r.choice(TYPES + ("person_name",))
        parts.insert(r.randint(0, len(parts)), (r.choice(CARRIERS[kind].split("|")), kind, value(r, kind)))
    if parts and r.random() < 0.25:
        # a value in the middle of a sentence of the background
        i = r.randrange(len(parts))
        if parts[i][1] is None and parts[i][0].count(" ") >= 2:
            ws = parts[i][0].split(" ")
            at = r.randint(1, len(ws) - 1)
            kind = r.choice(("email", "phone", "person_name", "person_name", "person_name", "address", "id_number"))
            parts[i] = (" ".join([*ws[:at], "{}", *ws[at:]]).replace("{}", "\0", 1).replace("{", "(").replace("}", ")").replace("\0", "{}"), kind, value(r, kind))
    if r.random() < 0.35:
        # a name between words that come before and after names, and words of the background
        ws = re.findall(r"\w+", background) or ["it"]
        some = lambda: " ".join(r.choice(ws).lower() for _ in range(r.randint(0, 4)))
        frame = re.sub(r"\s+", " ", f"{some()} {r.choice(['', r.choice(BEFORE)])} {{}} {r.choice(['', r.choice(AFTER)])} {some()}").strip()
        frame = frame[:1].upper() + frame[1:] if r.random() < 0.7 else frame
        parts.insert(r.randint(0, len(parts)), (frame + r.choice([".", ".", "?", "", ","]), "person_name", name(r)))
    for _ in range(r.choice((0, 0, 1, 1, 2))):
        parts.insert(r.randint(0, len(parts)), (near_miss(r, background), None, ""))
    if r.random() < 0.2:
        parts.insert(r.randint(0, len(parts)), (heading(r, background), None, ""))
    head = r.choice(["", "", f"job {_d(r, 9)}: ", f"ticket #{_d(r, 9)}: ", "user: ", f'{{"tool": "crm", "ref": "run-{_d(r, 7)}", "note": "'])
    text, spans = head, []
    for s, kind, v in parts:
        text += r.choice(["\n", "\n- "]) if text and text != head and r.random() < 0.12 else (" " if text and text != head else "")
        if kind:
            a, _, b = s.partition("{}")
            if "{2}" in b:
                other = value(r, kind)
                b0, _, b1 = b.partition("{2}")
            else:
                other = None
            core = v.strip("<>")
            start = len(text) + len(a) + v.index(core)
            spans.append((start, start + len(core), kind))
            text += a + v + b if other is None else a + v + b0
            if other is not None:
                spans.append((len(text), len(text) + len(other), kind))
                text += other + b1
        else:
            text += s
    return text, spans
