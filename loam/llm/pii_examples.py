"""Labelled spans to train the tagger on: sentences put together from parts in five languages, with personal items and
with look-alikes.

A sentence is an opening, the item and an ending, each drawn by itself, so that no fixed sentence can be learnt.
Every fifth opening, ending and filler is held out: it occurs in the examples of ``held=True`` only, which figures of
accuracy are taken from. Names come from public given names and from syllables, numbers from digits of the usual forms.
"""

from __future__ import annotations

import numpy as np

GIVEN = """Aaron Abigail Adam Adele Agnes Ahmed Aisha Alan Albert Alejandro Alexander Alice Amelie Amir Ana Andrea Andre Angela Anke Anna Anton Arjun
Arthur Astrid Axel Barbara Beatriz Benjamin Bernd Birgit Brian Bruno Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Chiara
Christian Christine Claire Clara Claude Daniel David Deborah Diana Diego Dieter Dmitri Dominique Dorothy Edith Eduardo Elena Elif Elizabeth
Emil Emily Emma Eric Esther Ethan Eva Fatima Felix Fernando Florian Francesca Frank Gabriel George Georg Gerda Greta Grace Hannah Hans
Harold Heinz Helen Helga Henrik Hugo Ibrahim Ines Ingrid Irene Isabel Ivan Jack Jacob James Jan Javier Jean Jennifer Jessica Joanna Johannes
John Jonas Jorge Joseph Juan Judith Julia Julien Jürgen Karin Karl Kathrin Kenji Kevin Klaus Lars Laura Leila Lena Leon Linda Louis Lucia
Luis Lukas Madeleine Manuel Marco Marcus Margaret Maria Marie Mark Marta Martin Mary Matthew Mei Michael Miguel Mohammed Monika Nadia Nathan
Nicole Nina Nora Olga Oliver Omar Oscar Pablo Patricia Paul Paula Pedro Peter Petra Philippe Priya Rachel Rafael Renate Richard Robert
Rosa Ruth Samuel Sandra Sara Sean Simon Sofia Stefan Susan Sven Tanja Teresa Thomas Tobias Ursula Victor Walter Yuki Yvonne""".split()
SURNAMES = """Smith Jones Taylor Brown Miller Wilson Moore Clark Lewis Walker Hall Young Allen King Wright Scott Baker Adams Nelson Carter Turner
Parker Collins Murphy Cook Rogers Bailey Cooper Reed Ward Watson Brooks Kelly Bennett Gray Hughes Price Russell Foster Müller Schmidt
Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger
Hartmann Lange Werner Krause Lehmann Köhler Maier Huber Martin Bernard Dubois Durand Moreau Laurent Lefebvre Leroy Roux Girard Bonnet
Dupont Lambert Fontaine Rousseau Vincent García Martínez López Sánchez Pérez Gómez Fernández Díaz Moreno Álvarez Romero Navarro Torres
Ramírez Gil Serrano Blanco Molina Castro Ortiz Rubio Silva Santos Ferreira Costa Rossi Russo Ferrari Bianchi Nowak Kowalski Novák Horvat
Ivanov Petrov Yılmaz Kaya Khan Patel Singh Sharma Kim Nguyen Tanaka Suzuki Okafor Mensah Andersen Hansen Johansson Lindqvist Virtanen""".split()
ENDINGS = ["son", "mann", "berg", "ski", "ová", "ez", "ini", "ier", "sson", "wick", "ton", "well", "ard", "eau", "o", "a", "ic", "er", "in", "ak", "ner", "ley", "dale", "quist"]
PARTICLES = ["van", "von", "de", "van der", "de la", "del", "di", "da", "dos", "von der", "le", "de Souza"]
TITLES = ["Mr", "Ms", "Mrs", "Dr", "Dr.", "Prof.", "Mr.", "Mrs.", "Herr", "Frau", "Sra.", "Sr.", "Señora", "Señor", "Mme", "Monsieur", "M.", "Madame"]
#: Frequent Chinese surnames and characters of given names.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛段雷龙黎史陶贺毛郝顾龚邵万钱戴严莫孔汤"
HAN_GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂兰华玉萍红鹏飞宇浩欣雨婷佳琪文建国志海晓东雪梅梓涵子轩思远俊凯晨阳博慧颖倩琳璐"
STREET_EN = ["Street", "St", "St.", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Ave.", "Boulevard", "Blvd", "Court", "Drive", "Dr", "Way", "Close", "Square", "Terrace", "Place", "Crescent"]
STREET_DE = ["straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ufer", "ring", "damm", "steig"]
WAY_FR = ["rue", "avenue", "place", "boulevard", "chemin", "impasse", "quai", "allée"]
WAY_ES = ["calle", "Calle", "avenida", "Avenida", "plaza", "paseo", "C/", "camino"]
NOUNS = "Oak Elm Birch Willow River Lake Hill Stone Bridge Mill Castle Market Chapel Garden Forest Meadow Valley Harbour Station School Park Sunset Victoria Albert Rose Copper Silver Lantern Falcon Beacon Cedar Granite Quarry Orchard Anchor Compass Thistle Weaver Foundry Heron Maple Juniper".split()
STEMS_DE = "Linden Mühlen Garten Berg Wiesen Schul Kirch Bahnhof Rosen Brunnen Feld Wald Haupt Dorf Blumen Goethe Schiller Kastanien Eichen Kapellen Ufer Sonnen".split()
WORDS_FR = ["des Lilas", "de la Gare", "du Moulin", "Victor Hugo", "de la République", "Saint-Jean", "du Général Leclerc", "des Écoles", "de l'Église", "Pasteur", "des Acacias", "Jean Jaurès", "du Pont", "des Tilleuls", "de la Fontaine", "du Vieux Port"]
WORDS_ES = ["Mayor", "de la Luna", "del Sol", "San Martín", "del Prado", "Nueva", "de Alcalá", "del Mar", "de los Reyes", "Real", "de la Paz", "Santa Ana", "Molino Viejo", "de la Fuente", "del Carmen", "Gran Vía"]
COUNTRIES = ["", "", "", "", ", Germany", ", France", ", Spain", ", USA", ", UK"]

#: What stands before an item and after it. ``_`` is the item; an empty part is a line's edge.
BEFORE = {
    "name": ["", "", "", "I spoke with", "We met", "They hired", "Call", "Please ask", "Write to", "A note from", "This is about", "My colleague", "My neighbour", "My sister", "Our client", "The patient is", "The tenant", "The new teacher,", "a letter to", "Remember", "I work with", "Meeting with", "Invite", "the lawyer", "Approved by", "Signed:", "From:", "To:", "Attn:", "thanks,", "Regards,", "dear", "Dear", "Best wishes from", "The author is", "her husband", "his boss", "Interview with", "Reported by", "assigned to", "owned by", "and", "with", "for", "by", "than", "Yesterday", "Tomorrow", "On Monday", "Apparently", "Last week", "because", "when", "that", "if", "Ich habe", "Gespräch mit", "Frag bitte", "laut", "Meine Ärztin", "mein Chef", "von", "für", "Gestern hat", "Hallo", "Liebe", "Im Auftrag von", "dass", "und", "J'ai vu", "avec", "Selon", "Bonjour", "Mon collègue", "ma voisine", "Le docteur", "chez", "Hablé con", "según", "Mi jefa", "el vecino", "Pregunta a", "Hola", "para", "con", "que", "1.", "-", "*", ">", "|", "("],
    "email": ["", "", "mail", "Email", "E-mail", "write to", "Contact:", "Send it to", "My address is", "reply to", "cc", "bcc:", "account", "login", "via", "from", "reach me at", "please use", "the mailbox", "forward to", "invite", "support at", "schreib an", "Kontakt:", "per Mail an", "an", "meine Mail:", "écrivez à", "courriel", "mon adresse est", "envoyer à", "correo", "escríbeme a", "mi cuenta es", "enviar a", "邮箱", "请联系", "发到", "mailto:", "<", "(", "or", "and", "copied", "subscribed as"],
    "phone": ["", "", "call", "Call me at", "phone", "Phone:", "tel", "Tel.", "mobile", "Mobile:", "cell", "fax", "Fax:", "ring", "text", "reach me on", "dial", "number", "The number is", "hotline", "or", "WhatsApp", "my new number", "Telefon", "Tel.:", "Handy", "ruf an:", "meine Nummer ist", "erreichbar unter", "Mobil:", "appelez le", "tél.", "portable", "mon numéro :", "joindre au", "llama al", "teléfono", "móvil", "mi número es", "电话", "手机", "请拨打", "手机号", "(", "contact", "voicemail", "after hours:"],
    "id_number": ["", "", "ID", "id:", "SSN", "SSN:", "social security number", "his SSN is", "passport", "Passport no.", "passport number", "the passport", "national insurance number", "NINO", "tax id", "Tax ID:", "TIN", "identity card", "ID card", "licence", "Ausweis", "Ausweisnummer", "Personalausweis", "Steuer-ID", "Steuernummer:", "Reisepass", "Kennnummer", "DNI", "DNI:", "NIE", "pasaporte", "carné", "número de identidad", "numéro de sécurité sociale", "carte d'identité", "passeport", "identifiant", "身份证", "身份证号", "护照", "证件号", "document", "personal number", "holder of", "with id"],
    "address": ["", "", "lives at", "I live at", "She lives at", "moved to", "address:", "Address:", "home:", "ship to", "send it to", "deliver to", "our house is at", "billing address", "located at", "visit us at", "parcel for", "the flat at", "return to", "from", "at", "near", "wohnt in der", "Adresse:", "Anschrift:", "Lieferung an", "wir wohnen", "zieht in die", "Rechnung an", "habite au", "adresse :", "livrer au", "domicile :", "au", "vive en", "domicilio:", "dirección:", "enviar a", "la casa de", "nos mudamos a", "住址", "地址", "寄到"],
}
AFTER = {
    "name": ["", "", "", ".", ".", ",", "!", "?", ";", ":", ")", " wrote this.", " called twice today.", " is on leave.", " agreed.", " said no.", " will join us.", " and the team", " and I", " or someone else", " from accounting", " about the contract.", " last week.", " yesterday.", " tomorrow", " now.", " again.", " please.", " was here", " has left the company.", " lives at", " lives nearby.", " owns the account", " likes tea", " prefers mornings.", " asked for help", " signed it.", " (owner)", " - see notes", ", who", ", my friend,", " as the contact.", " before you go.", " when you plan.", " during lunch.", "'s desk", "'s phone is off.", " hat angerufen.", " kommt morgen.", " gesehen.", " getroffen.", " ist krank.", " und", " gefragt.", " hat zugestimmt", " est absent.", " hier.", " a dit oui.", " viendra demain.", " et moi", " y yo", " está de viaje.", " dijo que sí.", " ayer.", " llamó.", " vendrá mañana.", "\n", " |", " ->"],
    "email": ["", "", "", ".", ".", ",", ";", ")", ">", "!", " please", " today.", " instead", " or call.", " for details.", " is mine.", " is the one.", " bounced.", " works.", " and", " by Friday", " now", " (work)", " bitte", " wenn nötig.", " ist besser.", " s'il te plaît", " avant midi.", " por favor", " si hay dudas.", "。", "\n", " |", " was added", " too"],
    "phone": ["", "", "", ".", ".", ",", ";", ")", "!", " please", " tonight.", " after six.", " is busy", " or mail me.", " anytime.", " ext. 4", " (office)", " and leave a message.", " works best", " now", " instead.", " bitte", " ab acht Uhr.", " erreichbar", " geht nicht.", " le matin.", " ce soir", " por la noche.", " si es urgente", "。", "\n", " |", " is new"],
    "id_number": ["", "", "", ".", ".", ",", ";", ")", "!", " was leaked.", " is on file.", " expired.", " must be removed", " for the visa.", " and", " ok", " was found in the log.", " belongs to her.", " ist abgelaufen.", " bitte löschen.", " gehört ihm", " est périmé.", " à supprimer", " caducó.", " hay que borrarlo.", "。", "\n", " |", " on the form"],
    "address": ["", "", "", ".", ".", ",", ";", ")", "!", " please.", " since May.", " now", " until June.", " is wrong.", " by noon.", " and ring twice.", " (second floor)", " seit März.", " bitte.", " im Hof", " depuis avril.", " au deuxième", " desde enero.", " segundo piso", "。", "\n", " |", " these days"],
}
SUBJECTS = ["the build", "this report", "our backlog", "a second draft", "the old server", "nobody", "everyone", "the garden", "my recipe", "the train", "that meeting", "a short memo", "the weekly plan", "the team", "someone", "the support desk", "the data model", "the night shift", "an assistant", "the printer", "the calendar", "that model", "the music list"]
VERBS = ["was late", "needs more time", "looks fine", "changed twice", "fails at night", "runs every morning", "should stay short", "was removed", "costs too much", "depends on the weather", "is stored in the cache", "must be tested", "was moved to the archive", "ended early", "will be merged", "got slower", "contains few rows", "ignores upper case", "was tuned in spring", "keeps the old limit"]
TAILS = ["", "", "", "because of the holidays", "after the update", "since the move", "in autumn", "by mistake", "without notice", "as agreed", "for now", "before lunch", "on Thursday", "in March", "this week", "again", "to save memory", "when the disk is full"]
FOREIGN = ["Der Bericht war zu spät, weil der Speicher voll war.", "Das Team prüft die Liste jeden Abend.", "Die Übersicht fehlt seit Montag.", "Wir haben den Plan gekürzt und später ergänzt.", "Nach dem Umzug blieb der Drucker aus.", "Für den Herbst gilt der alte Ablauf.", "Le rapport est en retard à cause de la panne.", "L'équipe vérifie la liste chaque soir.", "Nous avons raccourci le plan puis changé l'ordre.", "Dans ce dossier, il manque deux pages.", "El informe llegó tarde por la avería.", "El equipo revisa la lista cada noche.", "Cambiamos el orden y después el filtro.", "En esta carpeta faltan dos páginas.", "会议推迟到下周，因为资料还没有准备好。", "请把结果保存到文件夹里，以后再看。", "系统每天晚上检查一次列表。", "这个项目需要更多的时间和人手。", "我们决定先测试新的方法，再更新文档。", "天气很好，大家下午去公园。"]
#: nouns of everyday writing, with article, and what is done with them; German writes them with capitals
NOUNS_DE = ["der Bericht", "die Rechnung", "das Protokoll", "die Kollegin", "der Drucker", "die Tabelle", "das Büro", "der Vertrag", "die Sitzung", "das Archiv", "der Speicher", "die Abteilung", "das Werkzeug", "der Entwurf", "die Vorlage", "das Konto", "der Plan", "die Übersicht", "das Team", "der Termin", "die Leitung", "das Skript", "der Filter", "die Abfrage", "das Muster", "der Agent", "die Nachtschicht", "die Prüfung", "der Export", "die Warteschlange", "das Verzeichnis", "der Zeitplan", "die Notiz", "der Ordner", "die Sicherung", "das Training", "der Dienst", "die Redaktion"]
DONE_DE = ["geprüft", "gelöscht", "verschoben", "bestätigt", "gekürzt", "gemessen", "ersetzt", "geändert", "vergessen", "gespeichert", "bezahlt", "erneuert", "gesperrt", "umbenannt", "verloren", "ergänzt"]
NOUNS_FR = ["le rapport", "la facture", "l'équipe", "la réunion", "le contrat", "l'agent", "la table", "le dossier", "la relecture", "le calendrier", "l'index", "le filtre", "la file", "le planificateur", "la note", "le bureau"]
DONE_FR = ["a été supprimé", "a changé", "a refusé la demande", "a confirmé le plan", "a raccourci la liste", "reste vide", "a remplacé la clé", "est en retard", "a vérifié le compte", "ne répond plus"]
NOUNS_ES = ["el informe", "la factura", "el equipo", "la reunión", "el contrato", "el agente", "la tabla", "la carpeta", "el filtro", "el calendario", "la cola", "el índice", "la nota", "el planificador", "la guardia"]
DONE_ES = ["borró la lista", "cambió de sitio", "rechazó la petición", "confirmó el plan", "acortó el texto", "sigue vacía", "reemplazó la clave", "llegó tarde", "comprobó la cuenta", "no responde"]
UNITS = ["Tagen", "Minuten", "Stunden", "Zeilen", "Wochen", "Euro", "Seiten", "jours", "minutes", "lignes", "euros", "días", "filas", "minutos", "rows", "days", "units", "bytes", "megabytes", "percent", "tokens", "sessions", "dollars", "Stück", "天", "分钟", "行"]
THINGS = ["{P} {S}", "{P} {S}", "{P} {P} {S}", "Project {P} {P}", "Project {P}", "Operation {P}", "the {P} Room", "the {P} Team", "the {P} {P} Council", "{P} {S} Guide", "{P} Street Market", "Lake {P}", "Mount {P}", "North {P}", "New {P}", "Saint {P}", "{P} University", "{P} & {P} Ltd", "the {P} {S} release", "{P} Edition", "{X} {S}", "{X} and {X}", "{X} {X} {S}", "{P} Code Style", "Release {P} Notes", "Happy New Year", "Monday Morning Review", "Data Quality Report", "Senior Project Manager", "Head of Sales", "Product Owner", "Chief Data Officer", "Open Source Initiative", "Machine Learning Lab", "Team Lead", "North Sea", "Hong Kong", "San Francisco", "United Kingdom", "Rio Grande", "Visual Studio", "Apache Spark", "Night Shift Crew", "Version Control", "Dark Mode", "Error Budget Policy", "Customer Support", "Summer Sale", "Black Friday"]
SUFFIXES = ["Board", "Studio", "Pilot", "Suite", "Cloud", "Index", "Desk", "Hub", "Lab", "Flow", "Notes", "Engine", "Panel", "Tower", "Centre", "Hotel", "Bakery", "Museum", "Theatre", "Airport", "Station", "Café", "Format", "Guide", "Review", "Plan", "Report", "Dashboard", "Week", "Festival"]
USES = ["{} was renamed.", "{} is a product name.", "We use {} for drafts.", "The notes of {} are short.", "{} starts in June.", "We stayed in {} for two nights.", "{} and {} are different products.", "Compare {} with {}.", "{} needs a new logo.", "I read about {} online.", "ask in {} first", "{} has no owner yet.", "Welcome to {}.", "See {} for the rules.", "meet in {} at noon", "Nothing new in {}.", "Wir nutzen {} seit Mai.", "In {} gilt die alte Regel.", "Für {} gibt es keinen Termin.", "Dans {}, rien ne change.", "Avec {}, tout va plus vite.", "En {} no cambia nada.", "Para {} hay otra lista.", "我们在使用{}。", "{}发布了新版本。"]
NUMBERS = ["Version 9.99.9 is out.", "build 9999.99.99", "released on 2099-09-99", "at 99:99:99", "2099-09-09T99:99:99Z", "took 9999 ms", "id=xxxxxxxx", "commit xxxxxxxxxxxx", "hash xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "xxxxxxxx-xxxx-4xxx-axxx-xxxxxxxxxxxx", "trace 99999999-9999-4999-9999-999999999999", "host 99.9.99.9", "99.99.999.9 answered", "port 9999", "9,999,999 rows", "99 999 999 units", "99 999 999 rows", "cost: 99 999 999", "total 9 999 999 items", "a budget of 999 999 dollars", "Section 9, Main Street Music", "Page 99, High Road Trip", "Chapter 9: Old Street Life", "Lesson 99, Market Square Dance", "ticket ABC-9999", "issue #99999", "order 9999-9999", "invoice 2099-99999", "invoice no. 99999999", "pages 99-999", "range 9000-9999", "9999-9999-9999 is reserved", "row 999 of 9999", "99 % of 9999", "ratio 9.999e-9", "ttl=99999999", "timestamp 1699999999999", "from 1699999999 to 1799999999", "between 99999999999 and 99999999999 bytes", "limit 9999999999", "9x9 grid", "chapter 9, section 99", "step 9 of 99", "room 999", "gate A99", "flight LH 9999", "bus 999", "ISBN 979-9-99-999999-9", "pkg @scope/name@9.9.9", "npm i lib@99.9.9", "@team please look", "the handle @someone_9", "price@99", "size 99x99x99", "tel-aviv", "see https://host.test/a/9999999", "file_2099_99_99.csv", "IMG_99999999.jpg", "sensor 9 read 99.999", "v9.9.9-rc9", "SKU 99-999-99", "[EMAIL] was removed", "call [PHONE]", "<NAME> moved to [ADDRESS]", "[ID_NUMBER] is hidden", "see NAME and ADDRESS fields", "9 High Street Style tips", "Top 99 Street Food places", "The 9 Oak Street Rules for writers", "batch 99999999 done", "checksum 9xx9xx9xx9xx", "lot 9999 9999", "9999 9999 and 9999 99999", "temperature 99.9, pressure 9999.9", "9th of September 2099", "Article 99 Section 9", "error code 9999999", "retry in 999999 ms", "uptime 99999999 s", "0x9999xx99", "seed 99999999", "编号99999999", "共9999条记录", "2099年9月99日", "第99章"]


class Maker:
    """Draws examples; ``held``: only held-out parts of sentences, else only the others."""

    def __init__(self, seed: int, held: bool | None = False):
        self.rng = np.random.default_rng(seed)
        self.held = held
        self._parts: dict[int, list] = {}

    def pick(self, items):
        return items[self.rng.integers(len(items))]

    def part(self, items: list[str]) -> str:
        """One of the parts of this side of the split: every fifth distinct one is held out."""
        if id(items) not in self._parts:
            names = sorted(set(items))
            out = {x for k, x in enumerate(names) if k % 5 == 2 and len(x) > 2}
            self._parts[id(items)] = items if self.held is None else [x for x in items if (x in out) == self.held or (self.held and len(x) < 2)]
        return self.pick(self._parts[id(items)])

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(str(x) for x in self.rng.integers(0, 10, n))

    def fill(self, pattern: str) -> str:
        """Digits for 9, hexadecimal digits for x, capitals for Ā."""
        return "".join(str(self.rng.integers(10)) if c == "9" else self.pick("0123456789abcdef") if c == "x" else chr(65 + self.rng.integers(26)) if c == "Ā" else c for c in pattern)

    def stem(self, least: int = 1, most: int = 3) -> str:
        return "".join(self.pick(["b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "sch", "st", "t", "tr", "v", "w", "z", "qu", "kr", "pl", "gl", ""]) + self.pick(["a", "e", "i", "o", "u", "ae", "ei", "ou", "y", "ie", "ö", "ü", "á"] if self.chance(0.15) else ["a", "e", "i", "o", "u", "ae", "ei", "ou", "y"]) for _ in range(self.rng.integers(least, most + 1)))

    def invented(self) -> str:
        out = self.stem(1, 3) + self.pick(["", "n", "r", "l", "s", "th", "sk", "m", "x", "ton", "ville", "burgh", "haven", "ford", "dorf", "stadt", "mont", "ia", "um"])
        return out[:1].upper() + out[1:] if len(out) > 2 else "Nor" + out

    def surname(self) -> str:
        if self.chance(0.35):
            return self.pick(SURNAMES)
        out = self.stem(1, 3) + self.pick(ENDINGS)
        out = out[:1].upper() + out[1:]
        return f"{out}-{self.pick(SURNAMES)}" if self.chance(0.04) else out

    def given(self) -> str:
        if self.chance(0.15):
            out = self.stem(2, 3)
            return out[:1].upper() + out[1:]
        return self.pick(GIVEN)

    def name(self) -> str:
        g, s = self.given(), self.surname()
        kind = self.rng.integers(25)
        if kind in (0, 23, 24):
            return f"{s}, {g}"
        if kind in (1, 2):
            return f"{self.pick(TITLES)} {s}"
        if kind in (3, 4):
            return f"{g} {chr(65 + self.rng.integers(26))}. {s}"
        if kind == 5:
            return f"{g}-{self.pick(GIVEN)} {s}"
        if kind == 6:
            return f"{g} {s}".upper()
        if kind == 7:
            return f"{g} {self.pick(PARTICLES)} {s}"
        if kind == 8:
            return f"{g} {self.pick(GIVEN)} {s}"
        if kind == 9:
            return f"{self.pick(TITLES)} {g} {s}"
        if kind in (10, 11):
            return self.pick(HAN_SURNAMES) + "".join(self.pick(HAN_GIVEN) for _ in range(self.rng.integers(1, 3)))
        if kind == 12:
            return f"{chr(65 + self.rng.integers(26))}. {s}"
        if kind == 13:
            return f"{g} {s} {self.surname()}"
        return f"{g} {s}"

    def email(self) -> str:
        g, s = self.pick(GIVEN).lower(), self.surname().lower()
        user = self.pick([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{self.rng.integers(2000)}", f"{g}+{self.stem()}", g, f"{s}.{g}", f"{g}-{s}", f"{g}{self.rng.integers(99)}", f"{g[0]}.{s}", "info", "team." + s])
        word = self.stem(2, 3)
        host = self.pick([f"{word}.{t}" for t in ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "example", "test")] + ["example.com", "example.org", "mail.example.net", f"{word}-{self.stem()}.eu", f"mail.{word}.org"])
        kind = self.rng.integers(12)
        at, dot = [(" [at] ", "."), (" (at) ", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] ")][kind] if kind < 7 and self.chance(0.75) else ("@", ".")
        user = user.replace(".", dot) if dot != "." and self.chance(0.3) else user
        out = f"{user}{at}{host.replace('.', dot)}"
        return out.upper() if kind == 8 else out

    def phone(self) -> str:
        return self.fill(self.pick(["+49 999 99999999", "+49 (0)99 9999999", "+4999999999999", "0999 9999999", "0999/9999999", "099-9999999", "+44 99 9999 9999", "+44 9999 999999", "099 9999 9999", "(099) 9999 9999", "+1 999 999 9999", "+1-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "1-999-999-9999", "+33 9 99 99 99 99", "09 99 99 99 99", "09.99.99.99.99", "0033 9 99 99 99 99", "00 33 9 99 99 99 99", "+34 999 999 999", "999 999 999", "+34 999 99 99 99", "0049-99-99999-999", "0049 99 9999999", "+86 139 9999 9999", "13999999999", "139-9999-9999", "+91 99999 99999", "+31 9 99999999", "099 99 99 99", "(099) 99999999", "1-999-9999999", "+49 99 99999 999", "0049-99-99999-999", "0049-999-9999-99", "0044-99-9999-9999", "999.999.9999", "099/99999999", "+1 (999) 999-9999", "020 7999 9999"]))

    def id_number(self) -> str:
        label = self.pick(["", "", "", "SSN ", "DNI ", "passport ", "NINO ", "tax id ", "ID card ", "Ausweisnummer ", "Steuer-ID ", "national insurance number ", "identity no. "])
        return label + self.fill(self.pick(["899-99-9999", "999-99-9999", "999-99-9999", "99999999Ā", "X9999999Ā", "Ā9999999", "Ā99999999", "ĀĀ9999999", "ĀĀ999999", "LĀ9999999", "99 999 999 999", "99999999999", "QQ 99 99 99 C", "ĀĀ 99 99 99 Ā", "ĀĀ999999Ā", "9 99 99 99 999 999 99", "999999199999999999", "99999919999999999X", "LĀĀ999999", "Ā9ĀĀ99999", "99.999.999-Ā"]))

    def address(self) -> str:
        n, town = str(self.rng.integers(1, 400)), self.invented()
        kind = self.rng.integers(5)
        if kind == 0:
            first = self.pick(["", "", "", "", f"Apt {self.rng.integers(1, 90)}, ", f"apt {self.rng.integers(1, 90)}, ", f"Flat {self.rng.integers(1, 60)}, ", f"Unit {self.rng.integers(1, 60)}, ", f"Suite {self.rng.integers(1, 600)}, "])
            middle = " ".join(self.pick(NOUNS) if self.chance(0.7) else self.invented() for _ in range(self.rng.integers(1, 3)))
            last = self.pick(["", f", {town}", f", {town}", f", {town}", f", {town} {self.digits(5)}", f", {town}, {self.pick(['CA', 'NY', 'TX', 'OH'])} {self.digits(5)}", f", {town} {self.fill('ĀĀ9 9ĀĀ')}"])
            return f"{first}{n} {middle} {self.pick(STREET_EN)}{last}{self.pick(COUNTRIES) if last else ''}"
        if kind == 1:
            street = (self.pick(STEMS_DE) if self.chance(0.7) else self.invented()) + self.pick(STREET_DE)
            return f"{street} {n}{self.pick(['', '', '', 'a', 'b', ' c'])}{self.pick([', ', ', ', ' in '])}{self.digits(5)} {town}" if self.chance(0.85) else f"{street} {n}"
        if kind == 2:
            return f"{n}{self.pick([' bis', '', '', '', ' ter'])}{self.pick(['', '', ','])} {self.pick(WAY_FR)} {self.pick(WORDS_FR)}, {self.digits(5)} {town}"
        if kind == 3:
            return f"{self.pick(WAY_ES)} {self.pick(WORDS_ES)} {n}{self.pick(['', '', ', 2º B'])}, {self.digits(5)} {town}" if self.chance(0.8) else f"{self.pick(WAY_ES)} {self.pick(WORDS_ES)}, {n}, {town}"
        return f"{town}{self.pick(STREET_DE)} {n}, {self.digits(5)} {self.invented()}"

    def thing(self) -> str:
        out = self.part(THINGS)
        while "{" in out:
            out = out.replace("{P}", self.pick(NOUNS), 1) if "{P}" in out else out.replace("{S}", self.pick(SUFFIXES), 1) if "{S}" in out else out.replace("{X}", self.invented(), 1)
        return out

    def plain(self) -> str:
        """A sentence without personal items; many look like one."""
        kind = self.rng.integers(14)
        if kind > 8:
            return self.everyday()
        if kind < 2:
            use = self.part(USES)
            return use.format(*[self.thing() for _ in range(use.count("{}"))])
        if kind < 4:
            return self.fill(self.part(NUMBERS))
        if kind == 4:
            return self.part(FOREIGN)
        if kind == 5:
            x = self.pick([self.invented(), self.invented(), self.pick(NOUNS), self.pick(GIVEN)])
            return f"{self.pick(['In', 'Between', 'Für', 'Dans', 'En', 'Note for', 'Compared with', 'Until', 'Kill', 'Remember', 'Why', 'After', 'Decision:', 'Nach', 'À', 'Para', 'Since', 'From', 'Ask', 'With', 'The'])} {x}{self.pick(['', ',', ':'])} {self.part(SUBJECTS)} {self.part(VERBS)} {self.part(TAILS)}".rstrip() + self.pick([".", "", ";"])
        if kind == 6:
            return f"{self.invented()} {self.pick(['and', 'or', 'und', 'et', 'y', 'with'])} {self.invented()} {self.part(VERBS)} {self.part(TAILS)}".rstrip() + "."
        first = self.part(SUBJECTS) if self.chance(0.6) else self.invented()
        return f"{first[:1].upper()}{first[1:]} {self.part(VERBS)} {self.part(TAILS)}".rstrip() + self.pick([".", ".", "!", "?", ""])

    def everyday(self) -> str:
        """A sentence of everyday nouns in German, French, Spanish or English, perhaps with a place and a number."""
        a, b, x, y = self.pick(NOUNS_DE), self.pick(NOUNS_DE), self.invented(), self.invented()
        n = f"{self.pick(['', '', 'nach ', 'alle ', 'über ', 'mit ', 'seit '])}{self.rng.integers(1, 999)} {self.pick(UNITS)}"
        kind = self.rng.integers(10)
        tail = self.pick(["", "", f", weil {self.pick(NOUNS_DE)} fehlt", ", damit alles schneller geht", f" {n}", ", um Zeit zu sparen", " am Montag", " im Herbst"])
        if kind < 3:
            acc = b.replace("der ", "den ", 1)
            out = f"{a[:1].upper()}{a[1:]} hat {acc}{self.pick(['', '', f' von {x}', f' in {x}', f' aus {x}', f' {n}'])} {self.pick(DONE_DE)}{tail}"
        elif kind == 3:
            out = f"In {x} hat {a} {b.replace('der ', 'den ', 1)} {n} {self.pick(DONE_DE)}{tail}"
        elif kind == 4:
            out = f"{self.pick(['Für', 'Von', 'Bei', 'Mit', 'Nach'])} {x} gilt: {a} prüft {b} {n}{tail}"
        elif kind == 5:
            out = f"{self.pick(['À', 'Dans', 'Pour', 'Avec', 'Chez'])} {x}, {self.pick(NOUNS_FR)} {self.pick(DONE_FR)}{self.pick(['', f' après {n}', f' de {y}', ' hier', ', faute de temps'])}"
        elif kind == 6:
            out = f"{self.pick(['En', 'Para', 'Desde', 'Con'])} {x}{self.pick([',', '', ':'])} {self.pick(NOUNS_ES)} {self.pick(DONE_ES)}{self.pick(['', f' tras {n}', f' de {y}', ' ayer', ', por falta de tiempo'])}"
        elif kind == 7:
            out = f"{self.pick(['Between', 'From', 'Either', 'Both', 'Neither'])} {x} {self.pick(['and', 'or', 'to', 'nor'])} {y} {self.part(SUBJECTS)} {self.part(VERBS)} {n}"
        elif kind == 8:
            out = f"{self.pick(['In', 'At', 'Near', 'Within', 'Since', 'Until', 'Unlike', 'Compared with', 'According to'])} {x}, {self.part(SUBJECTS)} {self.pick(['of', 'in', 'for'])} {y} {self.part(VERBS)}"
        else:
            out = f"{x} {self.pick(['keeps', 'runs', 'moves', 'reads', 'needs', 'has', 'shares', 'renamed', 'lists'])} {n} {self.pick(['of', 'in', 'from', 'with'])} {y}"
        return out + self.pick([".", ".", ".", "!", "", ";"])

    def item(self) -> tuple[str, int, int, str]:
        kind = self.pick(["email", "phone", "phone", "phone", "id_number", "id_number", "address", "name", "name", "name", "name", "name"])
        value = getattr(self, kind)()
        before, after = self.part(BEFORE[kind]), self.part(AFTER[kind])
        han = "一" <= before[-1:] <= "鿿" or ("一" <= value[0] <= "鿿" and self.chance(0.7))
        if "一" <= value[0] <= "鿿" and self.chance(0.6):
            before, after = self.pick(["", "请联系", "昨天", "我同事", "和", "由", "经理", "姓名：", "告诉", "邀请", "根据", "病人", "老师", "给", "客户"]), self.pick(["", "。", "，", "说", "同意了", "负责", "的电话", "写了报告", "先生", "女士", "明天来", "住在", "和"])
        glue = "" if not before or before[-1] in "(<>" or before.endswith("mailto:") or han else self.pick([" ", " ", " ", " ", ": ", " = ", "\t"]) if before[-1] not in ":," else self.pick([" ", " ", ""])
        text = f"{before}{glue}{value}{after}"
        at = len(before) + len(glue)
        return text, at, at + len(value), kind

    def example(self, parts: int = 6) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for _ in range(parts):
            if self.chance(0.5):
                t, s, e, k = self.item()
                spans.append((len(text) + s, len(text) + e, k))
            else:
                t = self.plain()
            text += t + self.pick([" ", " ", " ", "\n", " | ", "\n- ", "; ", ". ", "\n\n", ", "])
        return text, spans
