"""The small labelled table from which the tagger of personal information is trained.

Sentences are everyday language (letters, shops, trains, clinics, logs), written by hand with a slot where a span stands. Slots are
filled with a fixed seed: names, streets and domains from short public lists and from made-up syllables, numbers by the forms of
several countries, plain words from a public vocabulary. Sentences without a span show what is no case. ROWS bounds the table. No
text of the tables that are tagged goes into it.
"""

from __future__ import annotations

import random
import re

ROWS = 6_000

# Sentences with slots. A slot in capitals is a span of that kind; {w} is any common word, {cap} a capitalised one.
SENTENCES = """
We are grateful to {NAME} for the loan of the van.
Thank you {NAME}, the cake was lovely.
The invoice was approved by {NAME}.
The minutes were written by {NAME} and sent out on Friday.
Signed by {NAME} in front of two witnesses.
Checked by: {NAME}
Could you talk to {NAME} about the deposit?
Please ring {NAME} if the train is late.
You had better speak with {NAME} before you book.
We had dinner at {NAME}'s flat.
The dog ran into {NAME}'s garden again.
It was {NAME}'s turn to drive.
{NAME} thinks the price is far too high.
{NAME} did not agree with the plan.
{NAME} is on holiday until the tenth.
Doctor {NAME} will see you now.
Dr. {NAME} changed the dose.
Mr. {NAME} left a message at noon.
Mrs. {NAME} paid in cash.
Ms {NAME} teaches the evening class.
Prof. {NAME} gave the first lecture.
Hello, my name is {NAME} and I would like to open an account.
I'm {NAME}, your driver for today.
This is {NAME} speaking, good morning.
Yours sincerely, {NAME}
Best wishes
(author: {NAME})
Passenger: {NAME}
Client: {NAME}
owner={NAME}; status=open
customer = {NAME}
name: {NAME}
The winners are {NAME} and {NAME}.
A meeting with {NAME} and {NAME} took place at the office.
Both {NAME} and the bank lost money.
The letter from {NAME} arrived on the first of March.
They introduced us to {NAME} on the ferry.
according to {NAME}, nothing was stolen
photo by {NAME}
Unterschrieben von {NAME}.
Der Vertrag wurde von {NAME} verlängert.
Mein Name ist {NAME} und ich rufe wegen der Rechnung an.
Ich bin {NAME} und wohne im zweiten Stock.
Das Fahrrad gehört {NAME}.
Wir danken {NAME} für die Einladung.
Frau {NAME} hat heute frei.
Herr {NAME} kommt später.
Firmado por {NAME}.
El contrato lo revisó {NAME} ayer.
Mi nombre es {NAME} y llamo por el alquiler.
Soy {NAME}, la vecina de arriba.
Damos las gracias a {NAME} por su ayuda.
La bicicleta es de {NAME}.
Signé par {NAME}.
Le contrat a été vérifié par {NAME}.
Mon nom est {NAME} et j'appelle pour la facture.
Je suis {NAME}, le voisin du dessous.
Nous remercions {NAME} pour son accueil.
Le vélo appartient à {NAME}.
Firmato da {NAME}, con molte grazie.
Write to {EMAIL} for a refund.
Email: {EMAIL}
e-mail {EMAIL}
Mail the form to {EMAIL} by the end of May.
You can also reach our office at {EMAIL} on weekdays.
if the parcel is lost, tell {EMAIL} at once
She dictated it as {EMAIL} over the phone.
her email is {EMAIL} I believe
From: <{EMAIL}>
cc={EMAIL};
to: {EMAIL}, subject: rent
Complaints should be sent to {EMAIL}, not to the shop.
Bitte schreiben Sie an {EMAIL} wegen der Karten.
Rückfragen: {EMAIL}
Escriba a {EMAIL} para más detalles.
Puede mandar la foto a {EMAIL} esta semana.
Merci d'écrire à {EMAIL} avant vendredi.
Renseignements : {EMAIL}
{EMAIL}
<{EMAIL}> unsubscribed yesterday.
Phone: {PHONE}
Tel {PHONE}
tel. {PHONE}
Fax {PHONE} or by post
Call {PHONE} to confirm the table.
Our new number is {PHONE}, the old one is dead.
My mobile is {PHONE} if the door is shut.
Please ring back on {PHONE} after six.
dial {PHONE} for the hotline
The poster shows {PHONE} in large type.
The caller left {PHONE} and hung up.
mobile={PHONE}
Rufen Sie uns an: {PHONE}
Sie erreichen mich unter {PHONE} bis acht.
Llámenos al {PHONE} por la mañana.
Mi número es {PHONE}, gracias.
Appelez le {PHONE} pour réserver.
Mon numéro est le {PHONE}, merci.
{PHONE}
Her social security number is {ID_NUMBER}.
The visa was stamped into passport {ID_NUMBER} at the border.
Passport no. {ID_NUMBER}
He showed licence {ID_NUMBER} to the officer.
Driver's license: {ID_NUMBER}
His identity paper {ID_NUMBER} ran out.
The bank copied identity card number {ID_NUMBER} twice.
Please quote your insurance number {ID_NUMBER} in every letter.
national id: {ID_NUMBER}
ssn={ID_NUMBER}
The clerk typed {ID_NUMBER} from the tax card.
Personalausweis: {ID_NUMBER}
Der Reisepass mit der Nummer {ID_NUMBER} wurde gefunden.
Mi carné es el {ID_NUMBER} y caduca pronto.
DNI {ID_NUMBER}
El pasaporte {ID_NUMBER} fue renovado.
Le passeport {ID_NUMBER} a été perdu.
Numéro de sécurité sociale : {ID_NUMBER}
carte nationale {ID_NUMBER}
{ID_NUMBER}
They live at {ADDRESS}.
Our shop moved to {ADDRESS} in June.
Please send the sofa to {ADDRESS} next week.
Address: {ADDRESS}
Ship to: {ADDRESS}, {town}
The taxi waited outside {ADDRESS}, {town}.
The house at {ADDRESS} is for sale.
a flat in {ADDRESS}, close to the park
deliver to {ADDRESS} after noon
The meeting point is {ADDRESS}.
{ADDRESS}
Anschrift: {ADDRESS_DE}
Wir wohnen jetzt in der {ADDRESS_DE}, {town}.
Lieferung bitte an {ADDRESS_DE}.
Der Laden in der {ADDRESS_DE} hat zu.
Mi casa está en {ADDRESS_ES}, {town}.
El taller se encuentra en {ADDRESS_ES}.
Envíe la mesa a {ADDRESS_ES}, {town}.
Dirección de entrega: {ADDRESS_ES}
Nous habitons {ADDRESS_FR}, {town}.
La boutique se trouve au {ADDRESS_FR}.
Livraison au {ADDRESS_FR}, {town}.
Adresse de livraison : {ADDRESS_FR}
L'ufficio è in {ADDRESS_IT}, {town}.
Follow @{w}_{w}_{n2} for news.
Order {n4}-{n3} was shipped on Monday.
Lot {n2}-{n3}-{n4} failed the pressure test.
Article AB-{n3}-{n2}/{n1} is out of stock.
The spare belt {A}{A}-{n3}-{n2}/{n1} fits this washing machine.
The token {n8} expired at {n2}:{n2}.
Random start 700{n5}, round {n1}.
Lines {n7}..{n7} of the ledger hold {n1} entries.
Version {n1}.{n2}.{n2}-beta{n1} crashed again.
Invoice {n6} lists {n2} chairs and {n2} lamps.
Green Valley Farm Shop, aisle {n2}, shelf {n2}, box {n1}.
The night bus has {n2} seats and {n2} windows on deck {n1}.
Wind from {n2} to {n2} knots, force {n1}.
Pressure {n2}.{n2} at {n1}.{n1} km, slope +{n1} %.
The song starts at {n2}:{n2}:{n2}.{n3} and lasts {n1} bars.
See page_{n4} and page_{n4} of volume {n1}.
½ litre + ¾ spoon ≈ {n3} g ±{n1} %
{n8}{n5} {n2},{n3}.{n3}e-{n1}
11111111111111111111{n2}
{n2}:{n2}.{n3} photo_{n6}.png a {w} {w} on the {w}
{n2}:{n2}:{n2} worker_{n3}.log the {w} {w} the {w}
[{n4}-{n2}-{n2} {n2}:{n2}:{n2},{n3}] INFO {w} {w} {n5} bytes
job_{hex} attempt {n1}/{n2} needed {n5} s
engine={w}-{w} speed={n1} checksum={hex}{hex}
build={hex} branch={w} took {n4} ms
sizes: [{n2}, {n3}, {n3}] total items {n2}
{{"boxes": {n2}, "weight": {n4}, "colour": "{w}"}}
ERROR {w} {w} missing, used default
note: {w} {w} a {w} {w} in the {w}
#{n3} {w} {w} ({w} {w})
Row {n3}.{n1}-{n3}.{n1} m: the {w} {w} a {w}, not confirmed.
{w} {w}; {w} {w} {w}
{w} {w} {w} {w}
The {w} {w} is {w} and the {w} {w} by the {w}.
A {w} {w} the {w} {w} into the {w} and {w} the {w}.
they {w} a {w} {w} for the {w} when the {w} {w}
Once a {w}, always a {w}: the {w} {w} is {w} like any {w} {w}.
We {w} the {w} and {w} a {w} because it is {w}.
I never {w} the {w}; the {w} one {w} {w}...
Well, I'm {w} the {w} {w}, and that is {w}!
Would you {w} the {w} {w}? fine, the {w} is {w}
Why did the {w} {w}: 1) the {w} {w}, 2) the {w}, 3) nothing at all?
The paper says so: a {w} {w} a {w} {w}, this {w} is {w}, {n1} out of {n2} {w} are {w}.
Is the {w} {w} between minute {n2} and minute {n2}, or is it {w} until {n2} {w} have passed?
Either a {w} or a {w} {w}?
{w} roughly {n2} pounds of {w} and we {w} for a {w}
Review of the {w} {w} by the {w}; the {w} is good for the {w}.
Moved from {w} to {w}, {w} {w}.
The express to {town} leaves from {town}, not from {town}.
{GIVEN} said so on Monday, and {GIVEN} agreed.
{GIVEN} forgot the keys.
The Red Cross and the {cap} Museum open at nine.
Visit New Orleans, Lake Geneva or the Black Forest this summer.
Central Station, North Hall, Platform {n1}
The Quick Start Guide To {cap} {cap}
{cap} {cap} {cap} {cap} {cap}
{cap} {w} {w} {w}. {cap} the {w} {w}.
Der Zug hält heute nicht in {town}, sondern fährt durch.
Die Katze schläft auf dem Sofa und der Hund wartet im Flur.
Ein Mann mit rotem Schal trägt die Kisten in den Keller, dann ruht er sich aus.
Morgen regnet es, also bleiben wir lieber zu Hause.
Die Kinder malen langsam ein großes Bild für die Schule.
Jemand hat das Licht im Flur brennen lassen.
El tren sale tarde y la gente espera en el andén.
Una señora riega las plantas del balcón y luego cierra la ventana.
Mañana vamos al mercado si no llueve mucho.
El niño dibuja despacio una casa con dos puertas.
El gato duerme encima de la silla azul.
Le train part en retard et les gens attendent sur le quai.
Une dame arrose les plantes du balcon, puis ferme la fenêtre.
Demain nous irons au marché s'il ne pleut pas.
L'enfant dessine lentement une maison avec deux portes.
Quelqu'un a oublié son parapluie dans l'entrée.
Il treno parte tardi e la gente aspetta.
De kat slaapt op de bank en de hond blaft.
Кошка спит на диване, а собака ждёт.
القطة تنام على الأريكة
猫がソファで寝ている。
Kot śpi na kanapie, a pies czeka.
fiancé cliché ﬂour
{cap} {w} {w} {NAME} {w} {w}.
{w} {w} {NAME}, {w} {w}
{w}={NAME}; {w}={w}
{w}={NAME}, {w}={n2}
{cap}: {NAME}
{w} in {NAME}'s {w} for a {w}.
{w} of {NAME}'s {w} {w}
the {w} was {w} by {NAME} on the {w} {w}.
{NAME} {w} the {w} {w}.
{NAME} and {NAME} {w} the {w}.
We cooked in {NAME}'s kitchen and slept in {NAME}'s tent.
So kind of {NAME}, {w} the {w}.
{cap} {w} {NAME} for the {w} and the {w}.
{cap} {w} {EMAIL} {w} {w}.
{w}: {EMAIL}
{w} as {EMAIL} {w} {w}
{cap} {w} {PHONE} {w} {w}.
{w} {w}, it's {PHONE}
{w}: {PHONE}
{cap} {w}, {PHONE}, {w} the {w}.
{w} {w} {PHONE} ({w})
{w} the {w} on {PHONE}.
{cap} {w} {ID_NUMBER} {w} {w}.
{w} {w} number {ID_NUMBER}.
passport {ID_NUMBER} {w} {w}
ID {ID_NUMBER}
ID card no. {ID_NUMBER}
Id nr {ID_NUMBER}
licence {ID_NUMBER} {w} {w} the {w}
She read {ID_NUMBER} out from the identity card.
Ausweis-Nr. {ID_NUMBER}
Die Nummer {ID_NUMBER} steht auf dem Ausweis.
documento de identidad {ID_NUMBER}
n.º de documento: {ID_NUMBER}
carte d'identité n° {ID_NUMBER}
pièce d'identité : {ID_NUMBER}
{cap} {w} {ADDRESS} {w} {w}.
{w} {w} {ADDRESS}, {town}.
{w}: {ADDRESS}
{w} at {ADDRESS}
{w} in {ADDRESS}, {town}.
Die Wohnung in der {ADDRESS_DE} ist leer.
Das Haus {ADDRESS_DE}, {town}, wird verkauft.
Er fand sie in der Wohnung {ADDRESS_DE}, {town}.
Sie warten im Büro {ADDRESS_DE}.
Das Sofa kommt in die Wohnung {ADDRESS_DE}.
La lettre va au {ADDRESS_FR}, {town}.
tourné dans la maison, {ADDRESS_FR}
La carta va a {ADDRESS_ES}, {town}.
{w} {w} {n3} {w}, {n2} {w} {n2} {w}
The factory recalled batch {n3}-{n2}-{n3} in spring.
Batch number {n3}-{n2}-{n3} {w} {w}.
This clip carries the code {A}{A}-{n4}, that frame the code {n6}.
Run {n8} of frame {n6} stopped at {n3}.
Spare part {A}{A}-{n3}-{n2}/{n1}, machine {n2}
lote {n3}-{n2}-{n3}; lot n° {n3}-{n2}-{n3}
{n8}{n5} {w} {n2},{n3}.{n3}e-{n1}
9876543210 {n2},{n3}.{n2}e-{n1}
{w} {n2}-{n2}, {w} {n3}/{n2}
Die Nachbarin kauft frisches Brot, und ihr Sohn spielt am Brunnen.
Der Lehrer erklärt die Aufgabe an der Tafel, während alle zuhören.
Eine Frau mit grünem Hut öffnet die Tür und stellt den Koffer ab.
Auf der Wiese grasen Schafe, daneben liegt ein alter Traktor.
Nach dem Essen räumt er den Tisch ab und wäscht die Gläser.
Der Bäcker mischt Mehl und Wasser und wartet, bis der Teig aufgeht.
Am Abend wird es kühl, darum zieht sie eine Jacke an.
Vor dem Rathaus steht ein großer Baum mit einer Bank darunter.
Er dreht den Schlüssel um, nimmt die Tasche und geht leise hinaus.
Un hombre con barba lava el coche junto al garaje y silba.
La maestra escribe en la pizarra mientras los alumnos copian.
El panadero mezcla harina y agua y espera a que suba la masa.
Por la noche refresca, así que ella se pone una chaqueta.
Después de comer recoge los platos, limpia la mesa y sale a pasear.
Delante del ayuntamiento hay un árbol grande con un banco debajo.
Alguien dejó las llaves puestas en la puerta, luego volvió a buscarlas.
La abuela corta el pan con un cuchillo y prepara la sopa encima del fuego.
Un homme barbu lave la voiture près du garage, puis siffle un air.
La maîtresse écrit au tableau pendant que les élèves recopient.
Le boulanger mélange la farine et l'eau, puis attend que la pâte lève.
Le soir il fait frais, alors elle met une veste.
Après le repas, il range l'assiette, nettoie la table et sort l'ordure.
Devant l'hôtel de ville, il y a un grand arbre avec un banc à l'ombre.
Quelqu'un a laissé les clés sur la porte, puis est revenu les chercher.
La grand-mère coupe le pain d'un geste et prépare la soupe à l'étage.
L'oiseau chante à l'aube, l'âne dort à l'étable, l'eau coule d'en haut.
I don't {w} it to {w}, so we can't {w} the {w}.
It's {w}, isn't it? That's a {w} I'll {w}.
I {w} the {w}. I know a {w}, but I don't {w}.
You shouldn't {w} a {w} {w}; they've {w} it
It was {NAME}.
{cap} {w} {w} {NAME}.
{w} {w} to {NAME}. {cap} {w} {w}.
{w} {NAME}. {cap} a {w} {w} {w}.
{cap} {w} {w}: {NAME}
{w}, says {NAME}.
Road closed from {n2} to {n2} km, lane {n1}.
road works from {n2} to {n2} m, depth {n1}.
{cap} {w} from {n2} to {n2} m, stage {n1}.
{n2} {w} @ {n2} {w}, {n3} {w} @ {n1} {w}
{w} @ {n1} per {w}
{w}: {w} {w}, {w}
{w}: {w}, {w} {w}
{w}: a {w} {w} {w} and {w} a {w} {w}
{w}: {w} {w}; {w} {w} {w}, {w}
{w} a {w} {w} and {w} it {w}, if you {w}
an {w} {w} of {w}, that's {w}; one {w} {w}, and {w}
{n2} pounds of {w}, if they {w} it, or {n2} {w} of {w}
{w} sha={hex}{n3}a {w}={hex}{n4}
entries {n8}{n1}..{n3} of the ledger
{cap} {n8}{n1}..0{n2} of a {w} {w} {n1} {w}.
{hex}{n4} {w} {w}={hex}{n4}
Mein Ausweis, {ID_NUMBER}, liegt zu Hause.
Ausweis Nr {ID_NUMBER}
une pièce d'identité, {ID_NUMBER}, valable dix ans
sa pièce d'identité {ID_NUMBER} est périmée
su documento {ID_NUMBER} no vale
{cap} {ID_NUMBER}
{cap} number: {ID_NUMBER}
social insurance number: {ID_NUMBER}
the social security number {ID_NUMBER} {w} {w}
{cap} {w} {ID_NUMBER}
{cap} {PHONE}
{w} {w} {w} {PHONE} {w}.
{w} le {PHONE} {w}
tél : {PHONE}
Tél. du bureau : {PHONE}
{cap} : {PHONE}
{cap} : {EMAIL}
{cap} : {ADDRESS_FR}
{cap}: {ADDRESS}
{cap}: {ADDRESS_DE}
{w} to {ADDRESS} {w} {w}
{cap} {w} {w} {ADDRESS}, {town}. {cap} {w} {w}.
{cap} {w} {ADDRESS}. {cap} {w} {w}.
one number, {PHONE}, {w} the {w}
the {w} {w} {PHONE} {w}. {cap} {w}
{w}, {w}; {w} {w}, {w}
{w} {w} {w}, {w}
A {w} {w} in {w} {w} {w} an {w}-{w} {w}.
<p> [TODO] heading?
""".strip().split("\n")

# Public given and family names, streets, towns and mail hosts for the slots; made-up ones stand beside them.
_GIVEN = "James Mary Robert Patricia Michael Linda William Elizabeth David Susan Thomas Sarah Karen Paul Laura Kevin Emily Hans Klaus Ursula Sabine Heike Jean Pierre Camille Luc Amélie Sylvie José Carmen Luis Pilar Javier Lucía Miguel Giulia Marco Paolo Fatima Omar Leila Ahmed Wei Ling Hiroshi Yuki Priya Arjun Anita Olga Sergei Tatiana Katarzyna Piotr Ingrid Lars Freya Chidi Amara Kwame Thandi Jean-Luc Mary-Ann Anna-Lena".split()
_FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Anderson Jackson Harris Clark Lewis Walker Young Wright Scott Baker Carter Müller Schmidt Schneider Fischer Weber Becker Schulz Hoffmann Dubois Moreau Laurent Lefebvre Girard Fournier García Fernández Martínez Sánchez Romero Torres Navarro Rossi Ferrari Bianchi Kowalski Nowak Ivanov Petrov Popescu Hansen Johansson Nielsen Virtanen Nguyen Tanaka Suzuki Kim Patel Singh Sharma Khan Hassan Okafor Mensah O'Brien O'Neill McDonald Fitzgerald".split()
_STREETS = "Oak Maple Cedar Mill Church Victoria Park Lake River Sunset Washington Lincoln Chestnut Willow Garden School Green Queen's King's Bridge Market Mozart Schiller Goethe Bahnhof Linden Pasteur Molière Verdi Garibaldi Cervantes Colón Mayor Libertad".split()
_TOWNS = "London Leeds Bristol Dublin Boston Denver Austin Berlin Hamburg Bremen Dresden Vienna Zürich Paris Lyon Lille Nantes Madrid Seville Bilbao Lisbon Rome Milan Turin Oslo Prague Warsaw".split()
_HOSTS = "gmail.com yahoo.com outlook.com hotmail.co.uk web.de gmx.net orange.fr telefonica.es libero.it company.com city-council.gov.uk school.edu bank.co.nz museum.org".split()
STREET_TYPES = "street st road rd lane ln avenue ave court ct close terrace crescent boulevard blvd drive dr way place pl square sq row hill straße strasse str weg platz allee gasse ring ufer rue avenue impasse chemin quai boulevard allée calle avenida plaza paseo camino carrera via viale piazza flat apt apartment unit suite room wohnung whg piso puerta bis appt appartement".split()
_ON = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh sk st t tr v w y z th".split()
_VOW = "a e i o u a e i o u ai ea ie ou y é ö ü á".split()
_OFF = "l m n r s t k d g b ck ll nn nd rt rs st lt x z sch ng".split()
_TLD = "com org net de fr es it io info co.uk eu ch edu example example.net test".split()
_TAGS = "news shop bills home 2024".split()


def _digits(r: random.Random, form: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "A" else c for c in form)


# How telephone and identity numbers are written in several countries; 9 is a digit, A a letter.
PHONES = "(999) 999-9999|999-999-9999|999.999.9999|+1 (999) 999-9999|+1 999-999-9999|+19999999999|+1 999 999 9999|1-999-999-9999|09999 999999|09999999999|+44 9999 999 999|+44 9999 999999|+449999999999|099 9999 9999|+44 99 9999 9999|+44 (0)99 9999 9999|0999/9999999|0999 9999999|099/99999999|+49 (0)99 99999 999|+49 99 99999999|0049 999 9999-999|0049 99 99999-999|09 99 99 99 99|09.99.99.99.99|+33 9 99 99 99 99|0999999999|+34 999 999 999|+34 999 99 99 99|999 99 99 99|999 999 999|+39 999 9999999|+31 9 99999999|+41 99 999 99 99".split("|")
IDENTITIES = "999-99-9999|999 99 9999|A99999999|A9999999|AA9999999|AA999999A|AA 99 99 99 A|AA 999999 A|AA 999 9999|A9 9999 999|A99 999 999|99999999A|99999999-A|A9999999A|A-9999999-A|AAA999999|99AA99999|999999999|AA-AA-99999-99|A999-9999-9999|AAA-99999-99|9 99 99 99 999 999|99 999 999 A".split("|")


class Filler:
    """Fills the slots. `words` are common lower-case words of a public vocabulary."""

    def __init__(self, seed: int, words: list[str]):
        self.r, self.words = random.Random(seed), words or ["thing"]
        self.spanned = [x for x in SENTENCES if re.search(r"(?<!\{)\{(?:NAME|EMAIL|PHONE|ID_NUMBER|ADDRESS)", x)]

    def one(self, xs):
        return xs[self.r.randrange(len(xs))]

    def made_up(self, parts: int) -> str:
        """A word of made-up syllables, capitalised."""
        s = "".join(self.one(_ON) + self.one(_VOW) + (self.one(_OFF) if self.r.random() < 0.55 else "") for _ in range(parts))
        return (s + self.one(["", "", "a", "o", "e", "i", "sen", "son", "s", "ic", "ian", "ez"])).capitalize()

    def _given(self) -> str:
        return self.one(_GIVEN) if self.r.random() < 0.5 else self.made_up(self.one([1, 2, 2]))

    def _family(self) -> str:
        one = lambda: self.one(_FAMILY) if self.r.random() < 0.35 else self.made_up(self.one([1, 2, 2, 2, 3]))
        f = one()
        x = self.r.random()
        return f"{f}-{one()}" if x < 0.12 else self.one(["van ", "de ", "von ", "de la ", "Mc", "El "]) + f if x < 0.18 else f

    def name(self) -> str:
        """A name as texts with capitals have it; texts without any are made of whole rows."""
        g, f, i = self._given(), self._family(), self.one("ABCDEFGHIJKLMNOPRSTUVWXYZ")
        s = self.one([f"{g} {f}"] * 9 + [f"{f}, {g}"] * 4 + [f"{i}. {f}"] * 3 + [f"{g} {i}. {f}"] * 3 + [f"{f}, {i}."] + [f"{f} {g}", f"{g} {self._given()} {f}"])
        return self.one([s] * 7 + [s.upper(), f"{f.upper()}, {g}", f"{g} {f.upper()}"]) if self.r.random() < 0.6 else s

    def email(self) -> str:
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower().translate(str.maketrans("öüéñóáíè", "ouenoaie"))) or "x"
        g, f = plain(self._given()), plain(self._family())
        local = self.one([f"{g}.{f}", f"{g}.{f}", f"{g[0]}{f}", f"{f}{self.r.randint(1, 99)}", f"{f}-{g[0]}", f"{g}_{f[0]}", f"{g}.{f}+{self.one(_TAGS)}", g, f"{g}{f}", f"{self.one(self.words)}.{self.one(self.words)}"])
        host = self.one(_HOSTS) if self.r.random() < 0.4 else self.one([self.made_up(2).lower(), self.one(self.words), f"{self.one(self.words)}-{self.one(self.words)}", f"{self.one(self.words)}.{self.made_up(1).lower()}"]) + "." + self.one(_TLD)
        d = re.sub(r"[^a-z0-9.-]", "", host)
        if self.r.random() < 0.15:
            local, d = (local.title(), d.upper()) if self.r.random() < 0.5 else (local, d.upper())
        at, dot = self.one([("@", ".")] * 6 + [(" [at] ", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]")])
        return local + at + d.replace(".", dot)

    def phone(self) -> str:
        return _digits(self.r, self.one(PHONES))

    def id_number(self) -> str:
        s = _digits(self.r, self.one(IDENTITIES))
        return s.lower() if self.r.random() < 0.12 else s

    def _street(self) -> str:
        s = self.one(_STREETS) if self.r.random() < 0.4 else self.made_up(self.one([1, 2, 2, 3]))
        return self.one(["Old ", "Upper ", "New ", "Saint ", "Little "]) + s if self.r.random() < 0.15 else s

    def _house(self, *more: str) -> str:
        return f"{self.r.randint(1, 299)}{self.one(['', '', '', '', 'a', 'b', 'C', *more])}"

    def address(self) -> str:
        t = self.one("Street Road Lane Avenue Court Close Terrace Crescent Ave Rd St. Blvd Drive Way Ln. Square Place Hill".split())
        base = f"{self._house()} {self.one(['', '', '', '', 'N. ', 'S. ', 'West '])}{self._street()} {t}"
        k = self.r.randint(1, 60)
        return self.one([base] * 4 + [f"Flat {k}, {base}", f"{base}, Unit {k}", f"{base}, Apt {k}{self.one('ABC')}", f"{base}, Apt. {k}", f"{base}, Flat {k}", f"Apartment {k}, {base}", f"{base}, Suite {k}"])

    def address_de(self) -> str:
        s, n = self._street(), self._house()
        base = self.one([f"{s}straße {n}", f"{s}str. {n}", f"{s}weg {n}", f"{s}-Allee {n}", f"{s}platz {n}", f"Am {s}ring {n}", f"{s}gasse {n}", f"{s}er Straße {n}"])
        return base + self.one(["", "", "", f", Whg. {self.r.randint(1, 40)}", f", Wohnung {self.r.randint(1, 40)}"])

    def address_fr(self) -> str:
        s, n = self._street(), self._house(" bis", " ter")
        base = self.one([f"{n}, rue de {s}", f"{n}, avenue {s}", f"{n} impasse du {s}", f"{n} rue {s}", f"{n}, chemin de {s}", f"{n} boulevard {s}", f"{n}, quai de la {s}"])
        return base + self.one(["", "", "", f", appt {self.r.randint(1, 40)}", f", appartement {self.r.randint(1, 40)}"])

    def address_es(self) -> str:
        s, n = self._street(), self._house(" bis")
        base = self.one([f"Avenida {s} {n}", f"Calle {s} {n}", f"Calle {s}, {n}", f"Calle de {s}, {n}", f"Plaza {s} {n}", f"C/ {s} {n}", f"Paseo de {s}, {n}", f"Avda. {s}, {n}"])
        return base + self.one(["", "", "", f", {self.r.randint(1, 9)}.º {self.one('ABC')}", f", {self.r.randint(1, 9)}º {self.one('ABC')}", f", piso {self.r.randint(1, 9)}", f", {self.r.randint(1, 9)}.º {self.one(['izq.', 'dcha.'])}"])

    def address_it(self) -> str:
        return f"{self.one(['Via', 'Viale', 'Piazza'])} {self._street()}{self.one([' ', ', '])}{self._house()}"

    def slot(self, kind: str) -> tuple[str, str | None]:
        r = self.r
        if kind in ("w", "cap"):  # some common words are in no vocabulary
            x = r.random()
            w = self.one(self.words) if x < 0.66 else self.made_up(self.one([1, 2, 2, 3])).lower() if x < 0.82 else self.one(self.words) + self.one(["y", "ed", "ing", "er", "less", "wise", "-" + self.one(self.words), self.one(self.words)])
            return w.capitalize() if kind == "cap" else w, None
        if kind == "town":
            return (self.one(_TOWNS) if r.random() < 0.4 else self.one(["", "", "", "Lower ", "Saint-", "Port "]) + self.made_up(2)), None
        if kind == "A":
            return self.one("ABCDEFGHKMPRSTX"), None
        if kind[0] == "n" and kind[1:].isdigit():
            return str(r.randint(10 ** (int(kind[1:]) - 1) if kind != "n1" else 0, 10 ** int(kind[1:]) - 1)), None
        if kind == "hex":
            return f"{r.getrandbits(32):08x}", None
        if kind == "GIVEN":
            return self._given(), None
        return getattr(self, kind.lower())(), "ADDRESS" if kind.startswith("ADDRESS") else kind

    def sentence(self, form: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", form):
            text += form[at : m.start()]
            at = m.end()
            if not m[1]:
                text += m[0][0]
                continue
            s, kind = self.slot(m[1])
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            text += s
        return text + form[at:], spans

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A few sentences in one text, in one of the layouts and cases that documents come in."""
        text, spans = "", []
        case = self.one([None] * 6 + [str.lower] * 3 + [str.upper])
        for _ in range(self.r.randint(2, 6)):
            form = self.one(SENTENCES) if self.r.random() < 0.6 else self.one(self.spanned)
            s, sp = self.sentence(form)
            if self.r.random() < 0.04 and not sp:
                s = s.title()
            # upper-casing may lengthen a text; such sentences keep their case
            if case and len(case(s)) == len(s):
                s = case(s)
            sep = self.one([" ", " ", " ", "\n", "\n", " | ", "  ", "\t"]) if text else self.one(["", "", "", "- ", "| "])
            spans += [(a + len(text) + len(sep), b + len(text) + len(sep), k) for a, b, k in sp]
            text += sep + s
        return text, spans


def labelled_table(words: list[str], rows: int = ROWS, seed: int = 20) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of the labelled table; every sentence occurs."""
    f = Filler(seed, words)
    return [f.row() for _ in range(rows)] + [f.sentence(x) for x in SENTENCES]


def known_names() -> tuple[list[str], list[str]]:
    """The public given and family names, of which the tagger is told at training and at work."""
    return _GIVEN, _FAMILY
