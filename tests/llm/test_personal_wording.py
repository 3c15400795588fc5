"""Personal details in wording of another origin: no sentence here comes from the test tables or from the operator's own labelled rows.

Details stand between braces as ``{kind:detail}``. Half of the names have no listed given name.
"""

import re

import pytest

pytest.importorskip("geoweft.llm")

from geoweft.llm import personal  # noqa: E402

LISTED = ["Amebert", "Calna", "Marlin", "Rose", "May", "Will", "Zorna", "Gavvo", "Amemek", "Selvo", "Rhona", "Grace", "Hunter", "Mark"]
PLACES = ["Mount Alder", "Rybgorsk", "Vilcalquira", "Saint Oskmere", "Averland", "Port Quillan", "New Tresham", "Oskmere"]

TEXTS = """
My landlord {name:Amemek Johnson} never answers his door.
Our plumber is {name:Gavvo Thompson} and he is cheap.
{name:Jonathan Whitaker} chaired the budget meeting on Tuesday.
We hired {name:Maria Gonzalez} as the new accountant last spring.
{name:Kim Thompson} met {name:Lee Carter} behind the gym.
Minutes taken by {name:Rhona Haverford}, approved without changes.
Yesterday the referee, {name:Thomas Okafor}, stopped the game early.
Has anyone got a lift home for {name:Selvo Brandt} after choir practice?
Kind regards, {name:Elena Petrova}
The violin belonged to {name:Zorna K. Adeyemi} before the war.
Our dentist Dr. {name:Priya Raman} retires in June.
{name:Calna Dufresne} won the chess club trophy again.
I sat beside {name:David Lindqvist} during the whole exam.
Please welcome {name:Sarah O’Connell} to the accounts team.
The defendant, {name:Peter Novak}, denied everything.
Invoices should be approved by {name:Marlin Castellano} from now on.
Attendance list: {name:Vasquez, Laura} arrived late.
Her uncle {name:Henrik Solberg} builds wooden boats.
Das Rezept stammt von {name:Andreas Vogel}, einem alten Freund.
Mi prima {name:Lucia Ferrer} canta en el coro del colegio.
Le gardien, {name:Olivier Marchand}, a fermé la grille.
Speaking next is {name:Grace Mbeki}, who needs no introduction.
Tell {name:Will Ashdown} that the ladder is back in the shed.
Mrs {name:Rose Kowalczyk} feeds the pigeons each morning.
{name:Hunter Delacroix} forgot the projector cable.
Reach the caretaker on {phone:020 7946 0018} after lunch.
The vet's emergency line is {phone:07700 900123}.
Dial {phone:+44 20 7946 0958} and ask for the kitchen.
Fax us at {phone:(312) 555-0143} if the printer jams.
My mobile: {phone:+1 415 555 2671}, mornings only.
For repairs phone {phone:0171 555 0199}.
SMS the code to {phone:+49 151 23456789} please.
Appelez le {phone:01 23 45 67 89} pour une livraison.
Mein Telefon ist {phone:030 1234567}, ruf an!
Teléfono de la tienda: {phone:+34 912 345 678}
The helpline, {phone:1-800-555-0199}, is open all night.
Text me, {phone:415-555-2671}, when the cake is ready.
Numer telefonu hydraulika: {phone:+48 601 234 567}
Landline {phone:0113 496 0000}, no voicemail.
Her number is {phone:202-555-0175} and she rarely picks up.
Call {phone:five five five two three six eight} and hang up after two rings.
Send the scans to {email:lab.results@northwood.example} before noon.
My work address is {email:t_okafor@ministry.gov.example}.
Reply to {email:jane dot doe at gmail dot com} with your shoe size.
Bookings: {email:hello+tables@blueheron.test}
Mail {email:quartermaster [at] scouts [dot] org} about the tents.
Complaints go to {email:box44@letters.co.uk}, not to me.
Subscribe through {email:gazette(at)townhall.net} for the minutes.
He answers {email:m.vogel@uni-aschen.de} on weekdays.
Write to {email:PRESS@HERALD.EXAMPLE} for tickets to the hearing.
{email:kofi at openfields dot net} collects old bicycles.
Envía tu currículum a {email:empleo@panaderia-lopez.es} hoy.
The passport office rejected {identity:AB1234567} because of a stain.
My social security number {identity:219-09-9999} was on the envelope.
National insurance: {identity:QQ 12 34 56 C}, starting in April.
Copy your tax id {identity:123.456.789-09} into box nine.
Her identity card {identity:X1234567L} had expired.
Steuer-ID {identity:4711 8899 123} bitte in das Formular eintragen.
The clerk read my passport number, {identity:C01234567}, aloud.
SSN {identity:078-05-1120} was printed on every wallet card.
Su DNI, {identity:12345678Z}, aparece en el contrato.
The citizen with id {identity:850101-1234} must sign twice.
Tax number {identity:987-65-4321} belongs to my late aunt.
Mój dowód {identity:ABC123456} zginął w tramwaju.
She lives at {address:48 Kestrel Lane} above the bakery.
Deliver the piano to {address:Flat 7, 112 Marlow Road} by Friday.
The old mill, {address:9 Saltmarsh Drive}, is haunted.
Our office moved from {address:301 Fourth Avenue} to somewhere cheaper.
Meet at {address:17b Queen Court} at eight.
Ich wohne in der {address:Lindenstraße 44}, zweiter Stock.
Ils habitent {address:12 rue Victor} depuis dix ans.
Vivimos en {address:Calle Mayor 23} con dos gatos.
Mam mieszkanie przy {address:ul. Polna 15/3}.
The fire started at {address:220 Birchwood Terrace} around noon.
Post it to {address:5 Orchard Close, Apt 2} please.
Moro na {address:Rua Augusta, 1500} perto do metrô.
Visit {address:64 Harbour Street} for second-hand lamps.
Я живу по адресу {address:ул. Садовая, д. 12, кв. 5}.
Ring twice at {address:88 Elmwood Crescent}.
invoice 415-555-2671 is unpaid
Order 123-45-6789 shipped yesterday with the wrong lamp.
Flight BA 2490 leaves from gate 14 at noon.
Firmware 10.4.2 fixes the blinking light.
The tracking code of the parcel is 4711 8899 123.
We walked 12 400 steps and ate 3 pies.
The lottery drew 4 8 15 16 23 42 again.
Our bus 64 turns into Harbour Street before six.
Forty street lamps went dark near the canal.
On Rose Street the tram stops twice.
The Rose Garden opens in March.
May Day was rainy in New Tresham.
They will walk to Mount Alder if the weather holds.
Final score: 112 to 98, what a match.
Port Quillan is lovely in autumn.
The New Bridge over the Rybna was closed.
Grace Period is the name of our quiz team.
Mark my words, the strike will end.
Bake at 180 for 45 minutes, then rest.
Ticket AB1234567 won a toaster.
Serial X1234567L is engraved below the lens.
Meet us at noon dot dot dot or whenever.
Room 301, Fourth floor, turn left.
Eggs are 3@1.20 this week.
ISBN 978-3-16-148410-0 is out of print.
The museum stands between Saint Oskmere and Vilcalquira.
My watch was made in 1987 and runs slow.
Barlow Motors sold us a broken van.
The Northern Line is suspended again.
Happy New Year from all of us!
Version 2.10.14 crashed twice, build 20 1187 too.
Follow @rose_kowal for the recipe.
It rained for 40 days and 40 nights.
Paris Match interviewed the mayor.
Monday Morning is a dreadful song.
The Golden Lion serves soup until ten.
""".strip().splitlines()
#: Written after the operator was finished and measured once (27 of 33 found, 1 false); since then only the format +1 (212) was added.
UNSEEN = """
The inspector asked {name:Ngozi Eze} for the second key.
A letter from {name:Calna Rutherford} lay on the desk.
{name:Viktor Hallström} repairs clocks in the old arcade.
Nobody believed {name:Rose Tannahill} until the tape was played.
The award goes to {name:Daniel Osei} and {name:Hannah Weiss}.
My teacher {name:Gavvo Lindgren} moved abroad.
Le boulanger {name:Henri Dubois} ferme à midi.
Unser Trainer {name:Lukas Baumann} ist krank.
La doctora {name:Pilar Iglesias} atiende los martes.
I owe {name:Zorna Whitlock} two coffees.
Prof. {name:Ada B. Nwosu} graded the essays.
Witnesses identified {name:Marlin Quist} as the cyclist.
The pharmacy can be reached at {phone:+33 1 44 55 66 77}.
Leave a voicemail on {phone:(020) 7946 0321}.
Our new line: {phone:01632 960 983}.
Ruf mich an: {phone:0176 12345678}
{phone:+1 (212) 555-0187} rings in the basement.
For towing call {phone:303.555.0122} at once.
WhatsApp {phone:+55 11 91234 5678} só à noite.
Questions? {email:ask.me@library.example}
Forward the minutes to {email:council_clerk@tresham.gov.uk} tonight.
Ping {email:noreply[at]metrics[dot]io} when the build breaks.
Contact {email:s.okoro at lakeside dot edu} about the keys.
His passport {identity:P7654321} was stolen on holiday.
The form wants my social security number {identity:457-55-5462}.
Insurance number {identity:AB 98 76 54 D} is missing a digit.
The consulate lost the visa of citizen {identity:760412-5678}.
The estate agent showed us {address:73 Foxglove Avenue}.
Their workshop at {address:8 Tanyard Lane, Unit 4} smells of glue.
Wir treffen uns in der {address:Gartenstraße 9}.
Nous vivons au {address:27 avenue Foch}.
The parade passes {address:150 Market Square}.
Package 457-55-5462 waits at the depot.
Our train 73 stopped before Foxglove Avenue.
Chapter 12 covers the years 1914 to 1918.
The Old Kings play at the Town Hall.
West Harbour froze over last winter.
Will power alone moved the cart.
Model P7654321 was recalled.
Add 250 grams of flour and 3 eggs.
The score stood at 21 to 19 after 40 minutes.
Booking 01632 960 983 was cancelled.
""".strip().splitlines()
MARKED = re.compile(r"\{(\w+):([^}]*)\}")


def parsed(line):
    text, spans, at = "", [], 0
    for m in MARKED.finditer(line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def scores(selector, lines):
    """Per kind (wanted, found, both), and what differs."""
    out, differ = {k: [0, 0, 0] for k in personal.KINDS}, []
    rows = [parsed(line) for line in lines]
    for (text, want), got in zip(rows, selector.select([t for t, _ in rows])):
        for kind in personal.KINDS:
            a, b = ({s for s in x if s[2] == kind} for x in (want, got))
            out[kind] = [n + m for n, m in zip(out[kind], (len(a), len(b), len(a & b)))]
            differ += [("-", kind, text[s[0] : s[1]], text) for s in a - b] + [("+", kind, text[s[0] : s[1]], text) for s in b - a]
    return out, differ


def test_recall_and_precision_on_other_wording():
    got, differ = scores(personal.Selector(LISTED, PLACES), TEXTS)
    for kind, (want, have, both) in got.items():
        assert both >= 0.9 * want and both >= 0.9 * have, (kind, want, have, both, differ)


def test_recall_and_precision_on_unseen_wording():
    got, differ = scores(personal.Selector(LISTED, PLACES), UNSEEN)
    want, have, both = (sum(v[i] for v in got.values()) for i in range(3))
    assert both >= 0.8 * want and both >= 0.8 * have, differ
