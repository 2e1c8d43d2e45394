"""Held-out labelled texts for the tagger: sentences, names, streets and hosts that occur in no row of its labelled table.

[KIND text] marks a span.
"""

import re

TEXTS = """
Last night [NAME Gwendolyn Achterberg] locked the library and left.
Has anybody seen [NAME Tobias Quarrington] since breakfast?
Tickets are held for [NAME Saoirse Mulvaney] and [NAME D. Papadakis].
The award went to [NAME Achterberg, Gwendolyn], our oldest member.
Nurse on duty: [NAME Rowena Featherstonehaugh]
Dr. [NAME T. Quarrington] prescribed rest.
The painting in [NAME Rowena Mulvaney]'s hallway was sold.
Ask for [NAME Ottoline J. Vasquez-Brandt] when you get there.
[NAME SAOIRSE MULVANEY] refused to pay the toll.
[NAME PAPADAKIS, Dimitra] wants a window seat.
editor={NAME Ottoline Papadakis}; revision=7
we were told by [NAME dimitra papadakis] that the pool is shut
my cousin [NAME tobias featherstonehaugh] fixed the roof
Gestern rief [NAME Gwendolyn Vasquez] im Hotel an.
Das Paket wurde von [NAME Tobias Papadakis] abgeholt.
Ayer nos visitó [NAME Rowena Quarrington] con su hermano.
Hier, [NAME Saoirse Vasquez] a perdu ses lunettes.
Warranty claims: [EMAIL helpdesk@brightkettle.co.uk]
Drop a line to [EMAIL t.quarrington+garden@plumtree.ie] and wait.
She can be found at [EMAIL rowena_m at plumtree dot ie] most days.
bounce: <[EMAIL D.PAPADAKIS77@BRIGHTKETTLE.CO.UK]> mailbox full
Schick die Fotos an [EMAIL ottoline [at] plumtree.ie], danke.
Reservations: [PHONE (718) 443-2096]
You will hear from us, or dial [PHONE +44 1865 402 117] today.
The sticker on the bin says [PHONE 0161 332 8874].
whatsapp [PHONE +34 622 71 38 04] for the keys
Notruf der Firma: [PHONE +49 (0)40 73318 226]
Un message du [PHONE 04 72 91 38 55] vous attend.
Her passport, number [ID_NUMBER K7304418], was stolen on the tram.
The form asks for a social security number, mine is [ID_NUMBER 418-52-7730].
National insurance [ID_NUMBER JH 47 20 91 C] was missing on the slip.
the officer wrote down licence [ID_NUMBER B6120447] and let us go
Seine Ausweisnummer lautet [ID_NUMBER T22048317].
Su DNI es [ID_NUMBER 50721846Q], según el contrato.
The fire broke out at [ADDRESS 83 Thistledown Crescent] before dawn.
Return the skis to [ADDRESS 12b Harbourmaster Lane, Flat 6], Falmouth.
new office: [ADDRESS 2207 Juniper Blvd, Suite 14], Tacoma
grandma still lives at [ADDRESS 5 thistledown road]
Die Praxis liegt in der [ADDRESS Kastanienstraße 41], Erfurt.
La farmacia está en [ADDRESS Calle Almendro, 17], Murcia.
Rendez-vous au [ADDRESS 29, rue des Peupliers], Annecy.
The kettle whistled twice before anybody noticed the smoke.
Flight 2217 left gate 14 at 06:45 with 182 people aboard.
Parcel 7731-204-19 weighs 4.2 kg and measures 30 x 40 cm.
Gwendolyn laughed, Tobias did not.
Rainfall rose from 12 to 48 mm within 3 hours.
{"pages": 311, "shelf": "north", "copies": 4}
2031-04-09 11:52:08,771 DEBUG queue drained, 5512 messages
sha1=9f3c07ab61de retry 2/5 took 881 ms
The Grand Canal, Mount Etna and the Golden Gate are on the list.
Wegen Nebels fährt heute keine Fähre zur Insel.
La panadería abre los domingos hasta el mediodía.
Les volets claquent quand le vent tourne au nord.
The recipe needs 250 grams of butter, 3 eggs and a pinch of salt.
I can't remember whether we've paid, so don't sign it yet.
""".strip().split("\n")


def parsed(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[([A-Z_]+) ((?:[^\[\]{}]|\[at\])+)\]|\{([A-Z_]+) ([^{}]+)\}", line):
        text += line[at : m.start()]
        kind, span = m[1] or m[3], m[2] or m[4]
        spans.append((len(text), len(text) + len(span), kind))
        text += span
        at = m.end()
    return text + line[at:], spans


def rows() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Each text alone, and joined by threes in each of two layouts."""
    one = [parsed(x) for x in TEXTS]
    out = list(one)
    for sep in (" ", "\n"):
        for a in range(0, len(one), 3):
            text, spans = "", []
            for x, sp in one[a::7][:3]:
                text += sep if text else ""
                spans += [(s + len(text), e + len(text), k) for s, e, k in sp]
                text += x
            out.append((text, spans))
    return out


def name_parts() -> set[str]:
    return {w.lower() for line in TEXTS for x, spans in [parsed(line)] for a, b, k in spans if k in ("NAME", "ADDRESS") for w in re.findall(r"[^\W\d_]{4,}", x[a:b])}
