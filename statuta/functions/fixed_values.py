"""Fixed values.

Word lists, dictionaries, limits, patterns and texts below must equal those of
the service whose results this library reproduces.  They are data, not logic,
so they are stated plainly and kept together here.
"""

# --- fixed values: input limits ------------------------------------------
MAX_QUESTION_LENGTH = 5000
MAX_QUERY_LENGTH = 1000
MAX_HISTORY_MESSAGES = 20
MAX_HISTORY_CONTENT_LENGTH = 4000
HISTORY_ROLES = ["user", "assistant", "model"]
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
EMBED_TEXT_LENGTH = 2000
SNIPPET_LENGTH = 500
PREVIEW_LENGTH = 300
MAX_RANGE_WIDTH = 50
MAX_LIST_NUMBERS = 20
FOLLOWING_LENGTH = 5

# --- fixed values: law names ----------------------------------------------
LAW_NAMES = {
    "4721": "Türk Medeni Kanunu",
    "6098": "Türk Borçlar Kanunu",
    "6100": "Hukuk Muhakemeleri Kanunu",
    "2004": "İcra ve İflas Kanunu",
    "6102": "Türk Ticaret Kanunu",
    "4857": "İş Kanunu",
    "7036": "İş Mahkemeleri Kanunu",
    "6183": "Amme Alacaklarının Tahsil Usulü Hakkında Kanun",
    "5237": "Türk Ceza Kanunu",
    "5271": "Ceza Muhakemesi Kanunu",
    "7201": "Tebligat Kanunu",
    "1136": "Avukatlık Kanunu",
    "6325": "Hukuk Uyuşmazlıklarında Arabuluculuk Kanunu",
    "2576": "Bölge İdare Mahkemeleri, İdare Mahkemeleri ve Vergi Mahkemelerinin "
            "Kuruluşu ve Görevleri Hakkında Kanun",
    "2577": "İdari Yargılama Usulü Kanunu",
    "6502": "Tüketicinin Korunması Hakkında Kanun",
    "4733": "Tütün, Tütün Mamulleri ve Alkol Piyasasının Düzenlenmesine Dair Kanun",
    "6698": "Kişisel Verilerin Korunması Kanunu",
}

# --- fixed values: law aliases, in rank order (earlier wins ties) ----------
# Spellings that fold to the same canonical form are listed once.
LAW_ALIASES = {
    "tck": "5237", "türk ceza kanunu": "5237", "5237": "5237",
    "tbk": "6098", "türk borçlar kanunu": "6098", "6098": "6098",
    "hmk": "6100", "hukuk muhakemeleri kanunu": "6100", "6100": "6100",
    "cmk": "5271", "ceza muhakemesi kanunu": "5271", "5271": "5271",
    "tmk": "4721", "türk medeni kanunu": "4721", "4721": "4721",
    "ttk": "6102", "türk ticaret kanunu": "6102", "6102": "6102",
    "iik": "2004", "icra ve iflas kanunu": "2004", "icra iflas kanunu": "2004",
    "2004": "2004",
    "iş kanunu": "4857", "4857": "4857",
    "avk": "1136", "avukatlık kanunu": "1136", "1136": "1136",
    "iyuk": "2577", "idari yargılama usulü kanunu": "2577", "2577": "2577",
    "arabuluculuk kanunu": "6325",
    "hukuk uyuşmazlıklarında arabuluculuk kanunu": "6325", "6325": "6325",
    "tkhk": "6502", "tüketicinin korunması hakkında kanun": "6502", "6502": "6502",
    "iş mahkemeleri kanunu": "7036", "7036": "7036",
    "tebligat kanunu": "7201", "7201": "7201",
    "amme alacaklarının tahsil usulü hakkında kanun": "6183", "6183": "6183",
    "bim kanunu": "2576",
    "bölge idare mahkemeleri idare mahkemeleri ve vergi mahkemelerinin kuruluşu "
    "ve görevleri hakkında kanun": "2576",
    "2576": "2576",
    "kvkk": "6698", "kişisel verilerin korunması kanunu": "6698", "6698": "6698",
    "aatuhk": "6183", "amme alacaklari kanunu": "6183",
    "bim": "2576", "bolge idare mahkemeleri kanunu": "2576",
    "idare ve vergi mahkemeleri kanunu": "2576",
    "tutun kanunu": "4733", "4733": "4733",
    "borclar kanunu": "6098",
    "medeni kanun": "4721", "ticaret kanunu": "6102", "icra iflas": "2004",
    "tebligat": "7201", "is mahkemeleri": "7036",
    "hukuk uyuşmazlıklarında arabuluculuk": "6325", "arabuluculuk": "6325",
    "calisma sureleri": "4857",
    "tebligat kan": "7201",
    "amme alacaklari": "6183",
    "tutun": "4733",
    "tebligat k": "7201",
}
# Aliases too general to count as naming a law by themselves (canonical form).
AMBIGUOUS_ALIASES = [
    "tebligat", "arabuluculuk", "tutun", "amme alacaklari", "calisma sureleri",
    "ticaret kanunu", "medeni kanun", "borclar kanunu",
]
SHORT_ALIAS_MAX_WORDS = 2
SHORT_ALIAS_MAX_CHARS = 24

# --- fixed values: regulation aliases (canonical form) ---------------------
REGULATIONS = {
    "verbis": ("6698", "Veri Sorumluları Sicili Hakkında Yönetmelik"),
    "mesafeli": ("6502", "Mesafeli Sözleşmeler Yönetmeliği"),
    "calisma": ("4857", "İş Kanununa İlişkin Çalışma Süreleri Yönetmeliği"),
    "arabuluculuk": ("6325", "Hukuk Uyuşmazlıklarında Arabuluculuk Kanunu Yönetmeliği"),
    "ticaret": ("6102", "Ticaret Sicili Yönetmeliği"),
    "tebligat": ("7201", "Elektronik Tebligat Yönetmeliği"),
}
REGULATION_ALIASES = {
    "veri sorumlulari sicili hakkinda yonetmelik": "verbis",
    "verbis yonetmeligi": "verbis",
    "kvkk yonetmeligi": "verbis",
    "mesafeli sozlesmeler yonetmeligi": "mesafeli",
    "tuketici mesafeli sozlesmeler yonetmeligi": "mesafeli",
    "is kanununa iliskin calisma sureleri yonetmeligi": "calisma",
    "calisma sureleri yonetmeligi": "calisma",
    "4857 calisma sureleri yonetmeligi": "calisma",
    "hukuk uyusmazliklarinda arabuluculuk kanunu yonetmeligi": "arabuluculuk",
    "arabuluculuk yonetmeligi": "arabuluculuk",
    "6325 arabuluculuk yonetmeligi": "arabuluculuk",
    "ticaret sicili yonetmeligi": "ticaret",
    "6102 ticaret sicili yonetmeligi": "ticaret",
    "elektronik tebligat yonetmeligi": "tebligat",
    "7201 elektronik tebligat yonetmeligi": "tebligat",
    "e tebligat yonetmeligi": "tebligat",
    "mesafeli sozlesmeler yon.": "mesafeli",
    "mesafeli sozlesmeler yon": "mesafeli",
    "elektronik tebligat yon.": "tebligat",
    "elektronik tebligat yon": "tebligat",
    "ticaret sicili yon.": "ticaret",
    "ticaret sicili yon": "ticaret",
}

# --- fixed values: number words --------------------------------------------
CARDINALS = {
    "sifir": 0, "bir": 1, "iki": 2, "uc": 3, "dort": 4, "bes": 5, "alti": 6,
    "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10, "yirmi": 20, "otuz": 30,
    "kirk": 40, "elli": 50, "altmis": 60, "yetmis": 70, "seksen": 80,
    "doksan": 90, "yuz": 100, "bin": 1000,
}
ORDINALS = {
    "birinci": 1, "ikinci": 2, "ucuncu": 3, "dorduncu": 4, "besinci": 5,
    "altinci": 6, "yedinci": 7, "sekizinci": 8, "dokuzuncu": 9, "onuncu": 10,
    "onbirinci": 11, "onikinci": 12, "onucuncu": 13, "ondorduncu": 14,
    "onbesinci": 15, "onaltinci": 16, "onyedinci": 17, "onsekizinci": 18,
    "ondokuzuncu": 19, "yirminci": 20, "otuzuncu": 30, "kirkinci": 40,
    "ellinci": 50, "altmisinci": 60, "yetmisinci": 70, "sekseninci": 80,
    "doksaninci": 90, "yuzuncu": 100, "bininci": 1000,
}
ROUND_ORDINALS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 1000]
COMPACT_WORDS = {
    "sekseniki": "seksen iki", "kirkdokuz": "kirk dokuz",
    "yuzondort": "yuz on dort", "yuzonbir": "yuz on bir", "yuziki": "yuz iki",
    "yuzuc": "yuz uc", "yuzyirmi": "yuz yirmi",
    "ondorduncu": "on dorduncu", "yuzondorduncu": "yuz on dorduncu",
    "yuzbirinci": "yuz birinci", "yuzikinci": "yuz ikinci",
}

# --- fixed values: article types -------------------------------------------
ARTICLE_TYPES = ["madde", "ek", "gecici", "ek_gecici", "mukerrer_madde", "mukerrer_ek"]
TYPE_LABELS = {
    "madde": "Madde",
    "mukerrer_madde": "Mükerrer Madde",
    "ek": "Ek Madde",
    "mukerrer_ek": "Mükerrer Ek Madde",
    "gecici": "Geçici Madde",
    "ek_gecici": "Ek Geçici Madde",
}

# --- fixed values: retrieval sources ----------------------------------------
SOURCE_PRIORITY = {
    "direct_article_lookup": 100,
    "direct_yonetmelik_lookup": 95,
    "semantic": 70,
    "semantic_or_keyword": 60,
    "keyword": 50,
    "reference_graph": 30,
    "previous_article_ref": 20,
}
OTHER_PRIORITY = 10
SIMILARITY_WEIGHT = 20.0
SAME_LAW_BONUS = 120.0
DISTANCE_BONUS = [(0, 150.0), (1, 60.0), (3, 30.0), (5, 10.0)]
SOURCE_PENALTY = {"reference_graph": 20.0, "previous_article_ref": 30.0}
EXPLICIT_LIMIT, MERGED_LIMIT, PREVIOUS_LIMIT, FINAL_LIMIT = 10, 10, 12, 18
PREVIOUS_EXTRA, GRAPH_EXTRA = 4, 6
SEMANTIC_COUNT, KEYWORD_COUNT, DECISION_COUNT, CASE_COUNT = 8, 4, 5, 5

# --- fixed values: "previous article" mentions -------------------------------
PREVIOUS_ARTICLE_PHRASES = ["yukarıdaki madde", "önceki madde", "bir üst madde"]

# --- fixed values: question vocabularies -------------------------------------
ARTICLE_TERMS = [
    "tbk", "tck", "cmk", "hmk", "iik", "iyuk", "tmk", "ttk", "kvkk",
    "kanun", "madde", "md", "m.", "fikra", "bent", "yonetmelik",
]
STRONG_DECISION_WORDS = [
    "yargitay", "danistay", "aym", "anayasa mahkemesi", "emsal", "ictihat", "hgk",
    "ceza genel kurulu", "hukuk genel kurulu", "karar no", "esas no",
]
DECISION_WORDS = ["karar", "karari", "kararini", "ictihat", "emsal"]
CASE_QUERY_WORDS = [
    "e", "k", "esas", "karar", "karari", "kararini", "sayili", "bul", "ara",
    "getir", "goster", "var", "mi", "hakkinda", "yargitay", "danistay", "aym",
    "anayasa", "mahkemesi", "hgk", "cgp", "cgk",
]
SEARCH_WORDS = ["ara", "bul", "getir", "goster", "var", "mi", "varmi"]
COURT_WORDS = ["yargitay", "danistay", "aym", "anayasa", "mahkemesi", "hgk", "cgp", "cgk"]
GENERIC_EXTRA_WORDS = ["hakkinda", "ile", "ilgili"]
CONTAINS_PLACE_WORDS = ["icinde", "icerisinde", "metninde", "lafzinda"]
CONTAINS_ASK_WORDS = ["geciyor mu", "gecer mi", "var mi", "yer aliyor mu"]
TECHNICAL_TERMS = {
    "illiyet bağı": ["illiyet bagi", "nedensellik", "nedensellik bagi"],
    "faiz": ["faiz", "yasal faiz", "temerrut faizi"],
    "zamanaşımı": ["zamanasimi"],
    "hak düşürücü süre": ["hak dusurucu sure"],
    "arabuluculuk": ["arabuluculuk"],
    "görevli mahkeme": ["gorevli mahkeme"],
    "yetkili mahkeme": ["yetkili mahkeme"],
    "dava şartı": ["dava sarti"],
}
TECHNICAL_ASK_WORDS = [
    "var mi", "gecer mi", "geciyor mu", "sart mi", "kosul mu", "gerekir mi",
    "istenebilir mi", "talep edilebilir mi", "uygulanir mi", "mumkun mu",
]
FULL_TEXT_WORDS = [
    "metnini aynen ver", "metnini ver", "madde metnini ver", "lafzini goster",
    "lafzini ver", "tam metin", "tam metnini ver", "aynen ver", "aynen goster",
]
PARAGRAPH_COUNT_WORDS = ["kac fikra", "fikra sayisi"]
PARAGRAPH_ORDINALS = {
    "birinci": "1", "ilk": "1", "ikinci": "2", "ucuncu": "3", "dorduncu": "4",
    "besinci": "5", "altinci": "6", "yedinci": "7", "sekizinci": "8",
    "dokuzuncu": "9", "onuncu": "10",
}
PLAIN_LOOKUP_EXCLUDED = [
    "karar", "ictihat", "emsal", "ihtar", "ihtarname", "dilekce", "sozlesme",
    "hazirla", "yaz", "taslak", "icinde", "metninde", "lafzinda", "geciyor",
    "var mi", "kac fikra", "fikra sayisi", "fikra", "bent", "acikla", "anlat",
    "ozetle", "kisaca", "metnini", "aynen", "tam metin", "lafzini",
]
ELEMENT_WORDS = [
    "sartlari", "kosullari", "unsurlari", "hangi sartlar", "hangi kosullar",
    "hangi unsurlar",
]
DRAFT_WORDS = ["ihtarname", "dilekce", "sozlesme", "taslak", "hazirla", "yaz"]
ELEMENT_DECISION_WORDS = ["karar", "ictihat", "emsal", "yargitay", "danistay", "aym"]
EXPLAIN_WORDS = [
    "acikla", "anlat", "ozetle", "kisa cevap", "kisaca", "iki cumle", "2 cumle",
]
DOCUMENT_WORDS = [
    "ihtarname", "ihtar", "dilekce", "taslak", "sozlesme maddesi", "metin hazirla",
    "belge hazirla", "taahhutname", "protokol", "muvafakatname", "basvuru",
]
TEMPLATE_WORDS = ["ornek", "sablon", "kisa", "5 cumle", "bes cumle", "genel", "standart"]
FACT_WORDS = [
    "olay su", "muvekkil", "karsi taraf", "tarihinde", "fatura", "sozlesme", "kira",
    "trafik kazasi",
]
SHORT_NOTICE_WORDS = ["kisa", "5 cumle", "bes cumle"]

# --- fixed values: answer audit ------------------------------------------------
UNSUPPORTED_TERMS = {
    "illiyet_bagi": ["illiyet bagi", "nedensellik bagi", "nedensellik"],
    "zamanaşımı": ["zamanasimi"],
    "hak_dusurucu_sure": ["hak dusurucu sure"],
    "faiz": ["faiz", "temerrut faizi", "yasal faiz"],
    "arabuluculuk": ["arabuluculuk", "dava sarti arabuluculuk"],
    "gorev_yetki": ["gorevli mahkeme", "yetkili mahkeme"],
}
FORBIDDEN_CASE_TERMS = [
    "yargıtay", "danıştay", "anayasa mahkemesi", "aym", "emsal karar",
    "yerleşik içtihat", "içtihatlarda", "kararlarda", "mahkeme kararlarında",
]
# Forms of a permitted citation of a plain article, after canonicalising.
CITATION_FORMS = [" madde ", " md. ", " md.", " m. ", " m.", " m ", " "]

# --- fixed values: answer texts ---------------------------------------------------
DISCLAIMER = "Bu bilgiler genel hukuki bilgi niteliğindedir, avukattan görüş alınız."
NO_SOURCE = (
    "Bu konuda veritabanımda yeterli kaynak bulunamadı. "
    "Kaynak bulunmadığı için hukuki değerlendirme yapamam.\n\n" + DISCLAIMER
)
NO_DECISION_HEAD = (
    "Bu konuda veritabanımda ilgili karar/içtihat kaynağı bulunamadı.\n"
    "Karar kaynağı bulunmadığı için Yargıtay, Danıştay veya emsal karar değerlendirmesi yapamam."
)
NO_DECISION_LIST = "Ancak ilgili mevzuat kaynakları aşağıdadır:"
FALLBACK_HEAD = (
    "Yanıt oluşturma servisi şu anda yoğun görünüyor.\n"
    "Ama ilgili kaynakları senin için buldum:\n"
)
FALLBACK_ARTICLES = "İlgili mevzuat ve yönetmelik:"
FALLBACK_DECISIONS = "\nİlgili kararlar:"
FALLBACK_NONE = "Bu konuda veritabanında ilgili kaynak bulunamadı."
STRICT_DECISIONS = "Kısa Cevap\n\nElimdeki karar veritabanında bulunan kaynaklar aşağıdadır:\n"
EMPTY_CONTEXT = "Veritabanında henüz kaynak bulunmamaktadır."
BASIS = "Dayandığı Kaynaklar:\n- "
LETTER_ONLY = (
    "Bu cevap yalnızca ilgili madde metninin lafzına ilişkindir; "
    "içtihat, doktrin veya uygulama değerlendirmesi yapılmamıştır."
)
STRUCTURE_ONLY = "Bu cevap yalnızca sistemdeki structured_content verisine ilişkindir."
GENERIC_SEARCH_MESSAGE = (
    "Karar araması yapabilmem için lütfen daha somut bir konu, kanun maddesi "
    "veya esas/karar numarası belirtin."
)
GENERIC_SEARCH_ANSWER = (
    GENERIC_SEARCH_MESSAGE + "\n\nÖrnekler:\n"
    "- TBK 49 hakkında Yargıtay kararı var mı?\n"
    "- 2022/585 kararını bul\n"
    "- İşe iade davası hakkında emsal karar ara\n\n" + DISCLAIMER
)
DECISION_ONLY_MESSAGE = (
    "Karar/içtihat odaklı arama yapıldı. "
    "Bu endpointte mevzuat sonuçları karara alternatif olarak gösterilmez."
)
BUSY_MESSAGE = (
    "Arama servisi şu anda yoğun. Geçici olarak metin eşleşmesine göre sonuçlar gösteriliyor."
)

# The two notice forms; {label} is the cited source.
SHORT_NOTICE = """İHTARNAME

İHTAR EDEN:
[Ad / Unvan]
[Adres]

MUHATAP:
[Ad / Unvan]
[Adres]

KONU:
Hukuka aykırı fiil nedeniyle doğan zararın giderilmesi talebidir.

AÇIKLAMALAR:
Tarafınızca gerçekleştirilen [olayın kısa açıklaması] nedeniyle [zarar gören kişi/şirket] zarara uğramıştır. {label} uyarınca, kusurlu ve hukuka aykırı bir fiille başkasına zarar veren kişi bu zararı gidermekle yükümlüdür. Bu nedenle [zarar tutarı / zarar kalemi] tutarındaki zararın işbu ihtarnamenin tebliğinden itibaren [süre] içinde giderilmesini talep ederiz.

SONUÇ VE İHTAR:
Belirtilen süre içinde zararın giderilmemesi halinde, yasal haklarımızı kullanacağımızı ihtaren bildiririz.

İHTAR EDEN / VEKİLİ
[Ad / Unvan]
[İmza]

""" + DISCLAIMER

LONG_NOTICE = """Kısa hukuki not
Bu taslak, {label} kapsamında genel amaçlı bir ihtarname örneği olarak hazırlanmıştır.
Somut olay, taraf bilgileri, zarar/borç tutarı ve süre alanları doldurulmadan kullanılmamalıdır.

İHTARNAME ÖRNEĞİ

İHTARNAME

İHTAR EDEN:
[Ad Soyad / Unvan]
[T.C. Kimlik No / Vergi No]
[Adres]

MUHATAP:
[Ad Soyad / Unvan]
[T.C. Kimlik No / Vergi No]
[Adres]

KONU:
[Hukuka aykırı fiil nedeniyle doğan zararın tazmini] talebimizden ibarettir.

AÇIKLAMALAR:

1. {label} uyarınca, kusurlu ve hukuka aykırı bir fiille başkasına zarar veren kişi, bu zararı gidermekle yükümlüdür.

2. Muhatap tarafından [tarih] tarihinde gerçekleştirilen [olayın kısa açıklaması] nedeniyle ihtar eden taraf zarara uğramıştır.

3. Söz konusu fiil nedeniyle doğan zarar [zarar kalemi ve tutar] olarak belirlenmiş olup, bu zararın giderilmesi talep edilmektedir.

4. Bu kapsamda muhatabın, işbu ihtarnamenin tebliğinden itibaren [süre] içinde [zararın/edimin] yerine getirmesi gerekmektedir.

5. Belirtilen süre içinde yükümlülüğün yerine getirilmemesi halinde, ihtar eden tarafın yasal haklarını kullanma hakkı saklıdır.

HUKUKİ NEDENLER:
{label} ve ilgili sair mevzuat.

DELİLLER:
[Sözleşme, fatura, yazışmalar, tutanak, fotoğraf, video, banka kayıtları, bilirkişi raporu ve sair yasal deliller]

SONUÇ VE İHTAR:
Yukarıda açıklanan nedenlerle; işbu ihtarnamenin tebliğinden itibaren [süre] içinde [zararın/edimin] yerine getirilmesini, aksi halde yasal haklarımızı kullanacağımızı ihtaren bildiririz.

İHTAR EDEN / VEKİLİ
[Ad Soyad / Unvan]
[İmza]

Uygulama Notları:
- Köşeli parantez içindeki alanlar somut olaya göre doldurulmalıdır.
- Zararın veya borcun miktarı açık ve belgeye dayalı yazılmalıdır.
- Belge gönderim yöntemi ve süre seçimi somut olaya göre ayrıca değerlendirilmelidir.

""" + DISCLAIMER

# --- fixed values: expected article numbers per law and type ------------------------
# "1-122" is an inclusive range; other items are single numbers.
# law, article type, first and last number, lettered numbers besides
EXPECTED_NUMBERS = [
    ("4857", "madde", 1, 122, []),
    ("4857", "ek", 1, 3, []),
    ("4857", "gecici", 1, 12, []),
    ("5237", "madde", 1, 244, ["123/A", "217/A", "245/A"]),
    ("5237", "madde", 246, 345, []),
    ("5237", "gecici", 1, 1, []),
    ("6098", "madde", 1, 649, []),
    ("6098", "gecici", 1, 2, []),
    ("6100", "madde", 1, 452, ["183/A", "305/A"]),
    ("6100", "ek", 1, 1, []),
    ("6100", "gecici", 1, 4, []),
    ("4721", "madde", 1, 1030, []),
    ("4721", "gecici", 1, 1, []),
    ("7036", "madde", 1, 39, []),
    ("7036", "gecici", 1, 1, []),
    ("6325", "madde", 1, 38, ["17/A", "17/B", "18/A", "18/B"]),
    ("6325", "gecici", 1, 3, []),
    ("2577", "madde", 1, 65, ["20/A", "20/B", "20/C"]),
    ("2577", "ek", 1, 3, []),
    ("2577", "gecici", 1, 11, []),
    ("7201", "madde", 1, 64, ["7/a", "25/a", "26/A"]),
    ("7201", "ek", 1, 2, []),
    ("7201", "gecici", 1, 2, []),
    ("6502", "madde", 1, 88, ["47/A", "57/A", "73/A", "77/A"]),
    ("6502", "gecici", 1, 3, []),
    ("1136", "madde", 1, 201, ["27/A", "35/A"]),
    ("1136", "ek", 1, 4, []),
    ("1136", "gecici", 1, 25, []),
    ("1136", "ek_gecici", 1, 1, []),
    ("6183", "madde", 1, 118, ["22/A", "36/A", "48/A", "74/A", "97/A"]),
    ("6183", "mukerrer_madde", 35, 35, []),
    ("6183", "ek", 1, 1, []),
    ("6183", "gecici", 1, 9, []),
    ("2576", "madde", 1, 17, ["3/A", "3/B", "3/C", "3/D", "3/E", "3/F", "3/G", "3/H", "3/I"]),
    ("2576", "ek", 1, 1, []),
    ("2576", "gecici", 1, 21, []),
    ("6102", "madde", 1, 1535, ["5/A"]),
    ("6102", "gecici", 1, 15, []),
    ("4733", "madde", 1, 12, ["4/A", "4/B", "8/A", "8/B"]),
    ("4733", "ek", 1, 4, []),
    ("4733", "gecici", 1, 9, []),
    ("6698", "madde", 1, 33, []),
    ("6698", "gecici", 1, 3, []),
]

# --- fixed values: article-body quality patterns ---------------------------------------
HEADING_PHRASES = [
    "BİRİNCİ BÖLÜM", "İKİNCİ BÖLÜM", "ÜÇÜNCÜ BÖLÜM", "DÖRDÜNCÜ BÖLÜM", "BEŞİNCİ BÖLÜM",
    "ALTINCI BÖLÜM", "YEDİNCİ BÖLÜM", "SEKİZİNCİ BÖLÜM", "DOKUZUNCU BÖLÜM",
    "ONUNCU BÖLÜM", "ONBİRİNCİ BÖLÜM", "ONİKİNCİ BÖLÜM", "Genel Hükümler",
    "İşin Düzenlenmesi", "İş Sağlığı ve Güvenliği",
    "Çalışma Hayatının Denetimi ve Teftişi", "İdari Ceza Hükümleri",
    "Çeşitli, Geçici ve Son Hükümler", "Vekâlet İlişkileri", "Vekâlet Sözleşmesi",
    "Kefalet Sözleşmesi", "Hizmet Sözleşmesi", "Kira Sözleşmesi", "Satış Sözleşmesi",
]
HEADING_LINES = ["amaç", "kapsam", "tanımlar", "istisnalar", "ücret", "yürürlük", "yürütme"]
SHORT_BODY = 120
CHANGE_NOTE_PATTERNS = [
    r"ibaresi .*? şeklinde değiştirilmiştir",
    r"ibaresinden sonra gelmek üzere .*? eklenmiştir",
    r"madde metninden çıkarılmıştır",
    r"madde metninden çıkartılmıştır",
    r"yürürlükten kaldırılmıştır",
    r"iptal edilmiştir",
    r"mülga",
    r"verilmiş yetkiye",
    r"cumhurbaşkanlığı kararnamesine",
    r"anayasa mahkemesinin .*? kararı ile",
]
PART_ORDINALS = [
    "BİRİNCİ", "İKİNCİ", "ÜÇÜNCÜ", "DÖRDÜNCÜ", "BEŞİNCİ", "ALTINCI", "YEDİNCİ",
    "SEKİZİNCİ", "DOKUZUNCU", "ONUNCU", "ONBİRİNCİ", "ONİKİNCİ",
]
APPENDIX_MARKER = "KANUNA EK VE DEĞİŞİKLİK GETİREN MEVZUATIN"
SUSPICION_RULES = [
    ("başlık bozukluğu olası", r"\bMadde\s+\d+\s*\(Mülga"),
    ("ek madde sızıntısı", r"\bEk\s+Madde\b"),
    ("geçici madde sızıntısı", r"\bGeçici\s+Madde\b"),
    ("değişiklik dipnotu sızıntısı", r"ibaresi .*? değiştirilmiştir"),
    ("dipnot sızıntısı", r"madde metninden çıkarılmıştır|yürürlükten kaldırılmıştır"),
    ("karar dipnotu sızıntısı", r"Anayasa Mahkemesinin .*? Kararı ile"),
]
TOO_SHORT_REASON = ("çok kısa", 80)

# --- fixed values: decision pages --------------------------------------------------------
DECISION_PAGE = {
    "drop_tags": ["script", "style"], "item_class": "birkarar", "info_class": "kararbilgileri",
    "subject_class": "basvurukonualani", "title_tag": "titles",
    "link_contains": "/BB/", "link_excludes": "Dil=",
    "body_classes": ["kararsonucalani", "ortaalan"],
    "side_classes": ["filtreler", "aravetemizle"],
    "start_marker": "TÜRKİYE CUMHURİYETİ",
    "subject_length": 600,
}
DECISION_SHORT_TEXT = 1000
DECISION_MIN_TEXT = 100

# What an article title may hold at most, and may not end or begin with.
TITLE_LIMITS = {"chars": 120, "digits": 6, "words": 12, "closing": (".", ";", ":"), "opening": "("}
# Patterns of headers inside running text: the place before a header, a line that begins with one, and
# a last sentence end with what follows it.
INLINE_HEADER = r"(?U)(?<!\n)(?<!Ek )(?<!Geçici )(?=\b(?:(?:Ek|Geçici)\s+)?Madde\s+\d)"
LINE_HEADER = r"(?iU)^(?:(?:ek|geçici)\s+)?madde\s+\d+"
SENTENCE_TAIL = r"^(.*[.!?])\s+([A-ZÇĞİÖŞÜ][^.]*)$"
# What a decision search says with its results, by route, and where it fell back to keywords.
SEARCH_MESSAGES = {
    "generic": "Karar araması yapabilmem için lütfen daha somut bir konu, kanun maddesi veya esas/karar numarası belirtin.",
    "decision_only": "Karar/içtihat odaklı arama yapıldı. Bu endpointte mevzuat sonuçları karara alternatif olarak gösterilmez.",
}
SEARCH_FALLBACK = "Arama servisi şu anda yoğun. Geçici olarak metin eşleşmesine göre sonuçlar gösteriliyor."
SEARCH_COUNT = 8
