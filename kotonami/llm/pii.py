"""Personal information inside free text: spans proposed by patterns, confirmed by checks and context.

Regular expressions propose spans on a width-folded copy of the text that keeps every
position. Each proposal starts from its pattern's own score; check digits (Luhn, mod 97, the
mod 11 of individual numbers) and words near by raise or lower it; what stays at 1 or more is
a mention. Overlaps go to the higher score, then to the longer span.

Names need no list: those that stand in telling contexts anywhere in the corpus give a
lexicon of name parts with the number of documents that have each. Parts in enough documents
speak for further mentions where the context alone is weak, such as a line of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonami.runtime import cut_lineage

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
#: Name parts count from this many documents in telling contexts on, however large the corpus is.
LEAST_DOCUMENTS = 3
#: A lexicon of more parts isn't broadcast, but joined to what each text asks for; about 200 bytes a part in a worker.
BROADCAST_PARTS = 200_000


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# -- folding that keeps positions ----------------------------------------------------------

_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20} | dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212), 0x2D)
_LONG_MARK = re.compile(r"(?<=\d)[ー―](?=\d)")


def folded(text: str) -> str:
    """ASCII for its full-width forms, hyphens for dashes, blanks for blanks: one character for each."""
    return _LONG_MARK.sub("-", text.translate(_FOLD))


# -- checks --------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def individual_number(digits: str) -> bool:
    """The check digit of a 12-digit individual number."""
    total = sum(int(d) * (n + 1 if n <= 6 else n - 5) for n, d in enumerate(reversed(digits[:11]), 1))
    return int(digits[11]) == (0 if total % 11 <= 1 else 11 - total % 11)


# -- patterns ------------------------------------------------------------------------------

_AT = r"(?:@|★|☆| ?[\[(<{](?:at|AT|アット)[\])>}] ?| at )"
_DOT = r"(?:\.| \. | ?[\[(<{](?:dot|DOT|ドット)[\])>}] ?)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+/-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: \. [A-Za-z0-9_%+-]+)?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}")
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|css|js|py|txt|md)$", re.I)
LINK = re.compile(r"(?:https?|ftp)://[^\s。、」）)>\]]+|www\.[^\s。、」）)>\]]+")

PHONE = re.compile(
    r"(?<![A-Za-z0-9_+./-])(?<![\d)] )(?:"
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?[ .-]?\d{2,4}[ .-]?\d{3,4}|\+\d{10,13}"
    r"|\(0\d{1,4}\)[ -]?\d{1,4}[ .-]?\d{3,4}|0\d{1,4}\(\d{1,4}\)\d{3,4}"
    r"|0\d{1,4}([ .-])\d{1,4}\1\d{3,4}|0\d{9,10}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\2\d{4}"
    r")(?:(?!\d)|(?=[12]\d{3}年))(?![.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![A-Za-z0-9.+-])(?:"
    r"[A-Z]{2}\d{8}[A-Z]{2}|[A-Z]{1,2} ?\d{7,8}|\d{4}([ -])\d{4}\1\d{4}(?:\1\d{4})?|\d{3}[ -]\d{2}[ -]\d{4}|\d{12}|\d{13,19}|\d{3}-\d{3}-\d{3}(?:-\d{3})?"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|\d{2,4}-\d{4,6}(?:-\d{1,6})?|\d{7,11}"
    r")(?![A-Za-z0-9])(?!-\d)"
)
#: Issuers' beginnings and lengths of payment cards.
_CARD = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11,16}|(?:6011|65\d\d|64[4-9]\d)\d{12,15}|35(?:2[89]|[3-8]\d)\d{12,15}|62\d{14,17}")
ID_WORDS = re.compile(r"個人番号|マイナンバー|免許証|旅券|パスポート|在留カード|保険証|被保険者|年金番号|口座番号|カード番号|身分証|社会保障|passport|social security|\bSSN\b|licen[cs]e|\bID card|identity|national id|insurance n|taxpayer|card number|\bIBAN\b", re.I)
PHONE_WORDS = re.compile(r"電話|携帯|連絡先|ファックス|\bTEL\b|\bFAX\b|\bphone|\bcall|\bring\b|\bmobile|\btext me", re.I)
OTHER_NUMBERS = re.compile(r"ビルド|伝票|注文|型番|品番|\bbuild|\bver\.|\bversion|\bISO\b|#|\border\b|\bpages\b|\bentries\b", re.I)

_NUM = r"(?:[0-9]{1,5}|[一二三四五六七八九十百〇]{1,4})"
_PREFECTURE = r"(?:北海道|東京都|京都府|大阪府|[一-鿿]{2,3}県)"
_PLACE = r"[一-鿿々ヶケノツ]"
_BLOCK = rf"(?:(?:[東西南北]?{_NUM}条[東西南北]?)?{_NUM}丁目(?:{_NUM}(?:番地?(?:の?{_NUM}号?)?|(?:-[0-9]{{1,4}}){{1,2}}|号)?)?|{_NUM}番地?(?:の?{_NUM}号?)?|[0-9]{{1,4}}(?:-[0-9]{{1,4}}){{1,3}}|[0-9]{{1,5}}号)"
_TOWNS = rf"(?:{_PLACE}{{1,7}}?[市区郡町村])+"
#: Kana stand in a town's name only behind a prefecture.
ADDRESS = re.compile(
    rf"(?:〒 ?)?(?:(?<!\d)\d{{3}}-\d{{4}} ?)?(?:{_PREFECTURE}{_TOWNS}(?:{_PLACE}|[ぁ-んァ-ヶー](?![、。]))" rf"{{0,10}}?"
    rf"|(?<![一-鿿々ヶケノァ-ヶ]){_TOWNS}(?:{_PLACE}|の(?=[一-鿿])){{0,8}}?){_BLOCK}"
)
_STREET_KIND = "Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Drive|Dr|Way|Court|Ct|Place|Pl|Terrace|Row|Close|Square|Sq|Hill|Boulevard|Blvd|Crescent|Highway|Hwy|Parkway"
STREET = re.compile(
    rf"(?<![\w.-])\d{{1,5}}[A-Z]? (?:[NSEW]\. )?[A-Z][a-z]+(?:[ -][A-Z][a-z]+){{0,3}} (?:{_STREET_KIND})\b"
    r"|\bP\.? ?O\.? Box \d{1,6}\b|(?<![\w.-])\d{1,4},? (?:rue|avenue|boulevard|place|chemin) (?:d[eu]s? |de la )?[A-ZÉ][\wé]+"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse) \d{1,4}[a-z]?\b"
)

_KANJI_NAME = r"[一-鿿々][一-鿿々ヶケノ]{0,4}(?: ?[一-鿿々]{1,4}(?:[ぁ-ん]{1,3})?|(?: [ぁ-ん]{1,6}))?"
_KANA_NAME = r"[ァ-ヶー]{2,9}(?: [ァ-ヶー]{2,7})?|[ぁ-んー]{2,9} [ぁ-んー]{2,7}"
_LATIN_WORD = r"(?:[A-Z][a-z]+(?:-[A-Z][a-z]+)?|[A-Z]{2,}|(?:Mc|O')[A-Z][a-z]+)"
_LATIN_NAME = rf"{_LATIN_WORD}(?: [A-Z]\.)?(?: {_LATIN_WORD}){{1,2}}|{_LATIN_WORD}, {_LATIN_WORD}(?: [A-Z]\.)?"
_ANY_NAME = rf"(?:{_LATIN_NAME}|{_KANA_NAME}|{_KANJI_NAME})"
_HONORIFIC = r"(?:さん|様|さま|氏(?!名)|先生|ちゃん|くん|君|殿)"
_PARTICLE = r"(?:から|より|まで|に|へ|が|を|は|の|と|も|、|。|宛|で|,|\.|!|！|\n|$)"
_BEFORE = r"(?:^|(?<=[。、\n>「『(（ 　:]))"
_ROLES = "部長|課長|係長|社長|会長|議長|店長|院長|校長|委員長|代表|主任|主査|秘書|理事|監督|選手|教授|講師|医師|弁護士|記者|首相|知事|市長|担当|担当者|同僚|友人|知人|先輩|後輩|夫|妻|息子|娘|長男|長女|次男|次女|兄|姉|弟|妹|従兄|従姉|恩師|作家|画家|歌手|俳優"
_LIFE = "生まれ|育った|に移り|移り住|引っ越|卒業|入学|留学|就職|入社|退職|転職|就任|退任|結婚|離婚|入院|退院|死去|亡くな|出席し|欠席し|会見し"
_LATIN_VERBS = "said|says|told|tells|wrote|writes|called|calls|asked|asks|replied|reports|reported|confirmed|confirms|suggested|suggests|noted|mentioned|explained|agreed|thinks|thought|noticed|joined|works|worked|lives|lived|moved|sent|phoned|emailed|answered|claims|claimed|believes|wants|pointed out|complained|promised|signed|resigned|died|married|was born|is our|is the author"
_LATIN_TO = "spoke|speak|talk|talked|talking|meet|met|meeting|contact|contacted|ask|asked|call|called|email|emailed|write|wrote|forward|forwarded|send|sent|reply|replied|thank|thanks|thanked|credit|kudos|credits|invite|invited|hired|tell|told|help|helped|mail|mailed|ping|assigned|addressed|introduced|married|interview|interviewed|according|reported|signed|written|reviewed|found|filed|confirmed|noted|dear"
#: Plain alternatives in both cases, which the matcher tells apart by their first letters.
_LATIN_TO = "|".join(f"{w}|{w.capitalize()}" for w in _LATIN_TO.split("|"))
_SIGN_OFF = r"(?:(?:Kind|Best|Warm|Many|With|Warmest|Kindest) )?(?:[Rr]egards|[Ww]ishes|[Tt]hanks|Sincerely|Cheers|Best|Yours truly|Yours sincerely|Yours faithfully|Sincerely yours|Thank you|Take care)"
#: (pattern, group of the name, score): names in their contexts, on folded text.
NAME_CONTEXTS = [
    (re.compile(rf"(?:氏名|名前|担当者?|責任者|承認者|代表者?|作成者|執筆者|著者|契約者|登録名|差出人|送信者|送り主|届け先|宛名|受取人|名義人?|署名|申請者)[ :=「『]+({_ANY_NAME})(?=[」』（(\n、。;／/]|$| *[\n<])"), 1.2),
    (re.compile(rf"(?<![一-鿿々ァ-ヶーA-Za-z])({_ANY_NAME})(?=と申します|といいます。|と名乗)"), 1.2),
    (re.compile(rf"(?:{_BEFORE}|(?<=[はがをへ]))({_ANY_NAME})(?=宛(?:で|に|です|ての|の|。|、))"), 1.2),
    (re.compile(rf"(?<![一-鿿々ァ-ヶーA-Za-z])({_KANJI_NAME}|{_KANA_NAME})(?={_HONORIFIC}{_PARTICLE})"), 1.0),
    (re.compile(rf"(?:{_ROLES})の({_KANJI_NAME})(?=が|は|を|に|と|も|から|より|へ|、|。|です|$)"), 0.7),
    (re.compile(rf"(?:私|僕|俺|わたし|わたくし)は({_ANY_NAME})(?=です|といい|と言い|と申|でござ)"), 1.0),
    (re.compile(rf"{_BEFORE}({_ANY_NAME})(?=は[^。\n]{{0,60}}(?:{_LIFE}))"), 0.7),
    (re.compile(rf"(?:お世話になっております|はじめまして|いつも使っています|こんにちは|こんばんは|おはようございます|初めまして)[。！!]\s*({_ANY_NAME})(?=です[。！!\n])"), 1.1),
    (re.compile(rf"(?:^|(?<=[。\n> ]))({_ANY_NAME})(?=です(?:[。！!\n]|$))"), 0.6),
    (re.compile(rf"\b(?:{_LATIN_TO})(?: (?:this|it|that|them|back|again))?(?: (?:to|with|by|from|for))?:?\s({_LATIN_NAME})"), 1.0),
    (re.compile(rf"\b(?:I am|I'm|[Mm]y name is|[Tt]his is|[A-Z][a-z]+(?:-[a-z]+)*-by:|From:|To:|Name:|Author:|Contact:?|Attn:?|Assignee:|Reporter:|Sender:|Customer:)\s+({_LATIN_NAME})"), 1.0),
    (re.compile(rf"\b(?:According to|Thanks to|Reported by|Credit to|Signed by|Asked by|Suggested by) ({_ANY_NAME})(?=,| <| and | for|\.|\n)"), 1.2),
    (re.compile(rf"\b(?:Mr|Ms|Mrs|Miss|Dr|Prof)\.? ({_LATIN_NAME}|{_LATIN_WORD})"), 1.2),
    (re.compile(rf"(?<![A-Za-z@./_-])({_LATIN_NAME})(?= (?:{_LATIN_VERBS})\b)"), 1.0),
    (re.compile(rf"(?:^|(?<=[.!?\n>] )|(?<=\n))({_LATIN_WORD})(?= (?:said|told|asked|replied|wrote) )"), 1.0),
    (re.compile(rf"\b{_SIGN_OFF},\s*(?:\n>? ?)?({_LATIN_NAME}|{_LATIN_WORD}|{_KANJI_NAME}|{_KANA_NAME})(?=[ .]*(?:\n|$))"), 1.2),
    (re.compile(rf"(?:^|\n)>? ?-- ?\n>? ?({_ANY_NAME})(?= *(?:\n|$))"), 1.2),
]
#: What joins a second name to one that was found: A and B, A、B.
_NEXT_NAME = re.compile(rf"(?: and | & |(?:{_HONORIFIC})?[、と・])({_ANY_NAME})(?={_HONORIFIC}|[、。,.\n]| for|$)")
#: Weak places: a line or a sentence that is nothing but a name; only the lexicon can confirm it.
WEAK_NAMES = [
    re.compile(rf"(?:^|(?<=\n)|(?<=\n> ))({_ANY_NAME}|{_LATIN_WORD})(?= *\.? *(?:\n|$))"),
    re.compile(rf"(?<=\n)({_KANJI_NAME}|{_KANA_NAME})(?=[12]\d{{3}}[-年]|https?:|@|\t|[#A-Z])"),
    re.compile(rf"(?<![A-Za-z@./_-])({_LATIN_NAME})(?![A-Za-z@_-])"),
    re.compile(rf"(?<![一-鿿々ァ-ヶーぁ-ん])({_KANJI_NAME}|{_KANA_NAME})(?=[（(<,、。 \n]|は|が|の|と|に|へ|も|です|{_HONORIFIC}|$)"),
]
#: For each name context words of which a text must have one; most texts skip most patterns.
NAME_TRIGGERS = [re.compile(t) for t in (
    "氏名|名前|担当|責任者|承認者|代表|作成者|執筆者|著者|契約者|登録名|差出人|送信者|送り主|届け先|宛名|受取人|名義|署名|申請者", "と申します|といいます。|と名乗", "宛[でにての。、]", "さん|様|さま|氏|先生|ちゃん|くん|君|殿",
    f"(?:{_ROLES})の", "[私僕俺]は|わたしは|わたくしは", _LIFE, "お世話に|はじめまして|初めまして|いつも使って|こんにちは|こんばんは|おはよう", "です",
    "[A-Za-z:]\\s[A-Z]", "I am|I'm|y name is|his is|-by:|From:|To:|Name:|uthor:|ontact|Attn|Assignee|Reporter|Sender|Customer", "According to|Thanks to|Reported by|Credit to|Signed by|Asked by|Suggested by", "\\b(?:Mr|Ms|Mrs|Miss|Dr|Prof)\\b", f"(?:{_LATIN_VERBS})", "said|told|asked|replied|wrote", "[Rr]egards|[Ww]ishes|Sincerely|Best|Cheers|[Tt]hank|Yours|Take care", "--",
)]
_BLOCK_TRIGGER = re.compile("[丁番号条]|[0-9]-[0-9]")
_TOWN_TRIGGER = re.compile("[市区郡町村]")
_STREET_TRIGGER = re.compile(r"[A-Za-zß.] \d|\d[A-Z]?,? [A-Za-z]")
_COMPANY_BEFORE = re.compile(r"(?:株式会社|有限会社|合同会社) ?$")
_COMPANY_AFTER = re.compile(r" ?(?:製作所|商事|商店|工業|銀行|大学|株式会社|有限会社|市|町|村|区|駅|県|郡|Inc\b|Ltd\b|Co\.|LLC\b|Corp|Works\b|Park\b|パーク|ホール|Hall\b|ビル)")
#: Nouns that take an honorific or stand behind a role without being a name, by beginning, by ending and whole.
_NOT_NAMES = re.compile(
    r"^(?:お客|皆|神|王|奥|仏|殿|各位|担当|弊社|御社|貴社|本人|自分|相手|全員|誰|何|先方|当方)"
    r"|^(?:客|運転手|医者|店員|駅員|社員|会員|職員|患者|業者|記者|学生|生徒|子供|赤|旦那|主人|母|父|兄|姉|弟|妹|祖父|祖母|叔父|叔母|孫|嫁|娘|息子|利用者|参加者|読者|作者|著者|看護師|大家|花嫁|隣|店長|社長|部長|課長|会長|校長|先輩|後輩|同)$"
)
_NO_PERSON = re.compile(r"(?:会|部|所|社|力|者|用|的|性|化|見|書|品|物|日|年|月|間|度|等|数|額|面|長|員|後|前|中|時|方|店|国|語|学|校|市|町|村|県|駅|線|号|式|法|表|版|案|件|点|側|内|外|上|下|場|室|館|駅|山|川|島|橋|寺|城|港|人)$")
#: Capitalised English words that begin a sentence or name no person.
_LATIN_STOP = frozenset(
    "A About According After All Also An And Another Any Are As At Attn Avenue Bank Be Because Before Best Both Bug But By Can Cc Cheers City Closes College Committee Company Contact Could Council County Customer Dear Department Did Do Does Each East Either English Error Even Every Expected FAQ FAX Fixes For French From German Go Government Had Has Have He Hello Help Her Here Hi His How Howdy However I If In Instead Is Island Issue It Its Japanese Just Kind Kindly Lake Last Later Let Linux Love Mac Mail Many Market May Maybe Merges Might Monday Most Mount Museum My Network New Next No North Not Note Now OK OS Of Office Often On Once One Only Or Other Our Page Park Patch Perhaps Please Press Previously Re Regards Release Reported Reports Resolves Reverts River Road Section See Server She Should Since Sincerely So Social Some Sometimes South Station Step Still Store Street Sunday Support Sure System TEL Team Test Thank Thanks That The Their Then There These They This Those Though Thus To Today Tomorrow Town Tuesday Typing Ubuntu Unicode University Until Update User Users Version Very Via Was We Web Wednesday Well Were West What When Where Which While Who Why Will Windows With Would Yes Yesterday You Your Zoom Thursday Friday Saturday January February March April June July August September October November December "
    "API CPU CSV DNS GPU HTML HTTP HTTPS IBAN ID IME IP ISO JSON PC PDF RAM ROM SDK SQL SSH SSN TODO UI URL USB UTF VM XML YAML Actual Candidates".split()
)


def name_parts(name: str) -> list[str]:
    """The parts of a name that the lexicon counts: words, initials left out; capitals as they begin a word."""
    return [w.capitalize() if w.isascii() else w for w in re.split(r"[ ,]+", name) if len(w.rstrip(".")) > 1]


class Finder:
    """Mentions in texts, with a lexicon of name parts (documents that have each)."""

    def __init__(self, lexicon: dict[str, int] | None = None):
        self.lexicon = lexicon or {}
        self.known = set(self.lexicon)
        self.beginnings = {p[:2].casefold() for p in self.known}

    # -- kinds --

    def emails(self, text: str) -> Iterator[Span]:
        for m in EMAIL.finditer(text):
            score = 1.2 if "@" in m[0] or "[" in m[0] or "(" in m[0] or "★" in m[0] or "☆" in m[0] else 0.7
            if _FILE.search(m[0]):
                score -= 1
            yield Span(m.start(), m.end(), "email", score)

    def phones(self, text: str) -> Iterator[Span]:
        for m in PHONE.finditer(text):
            digits = sum(ch.isdigit() for ch in m[0])
            score = 0.4 + 0.5 * (10 <= digits <= 13) - 1.0 * (digits < 9 or digits > 14)
            if m[0][0] in "+(" or re.match(r"0[789]0", m[0]):
                score += 0.3
            elif not m[0].isdigit():
                score += 0.2
            score += 0.4 * self._near(PHONE_WORDS, text, m, 16, 12) - 1.0 * self._near(OTHER_NUMBERS, text, m, 8, 0) - 0.8 * self._near(ID_WORDS, text, m, 14, 10)
            yield Span(m.start(), m.end(), "phone", score)

    def id_numbers(self, text: str) -> Iterator[Span]:
        for m in ID_NUMBER.finditer(text):
            raw = re.sub(r"[ -]", "", m[0])
            score = 0.2
            if re.fullmatch(r"[A-Z]{2}\d{8}[A-Z]{2}", raw):
                score += 0.6
            elif re.fullmatch(r"[A-Z]{2}\d{7}", raw):
                score += 0.3
            elif re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", raw):
                score += 0.9 if mod97(raw) else 0.0
            elif raw.isdigit() and len(raw) == 12:
                score += 0.1 + 0.2 * individual_number(raw)
            elif raw.isdigit() and 13 <= len(raw) <= 19:
                score += 0.8 * (luhn(raw) and _CARD.fullmatch(raw) is not None)  # check digit, issuer and length agree
            score += 1.0 * self._near(ID_WORDS, text, m, 32, 14) - 1.0 * self._near(OTHER_NUMBERS, text, m, 8, 0)
            yield Span(m.start(), m.end(), "id_number", score)

    def addresses(self, text: str) -> Iterator[Span]:
        for m in ADDRESS.finditer(text) if _TOWN_TRIGGER.search(text) and _BLOCK_TRIGGER.search(text) else ():
            strong = "丁目" in m[0] or "番" in m[0] or m[0][0] in "〒0123456789" or re.match(_PREFECTURE, m[0]) or "-" in m[0]
            yield Span(m.start(), m.end(), "address", 1.5 if strong else 0.5)
        for m in STREET.finditer(text) if _STREET_TRIGGER.search(text) else ():
            yield Span(m.start(), m.end(), "address", 1.4)

    def names(self, text: str) -> Iterator[Span]:
        for (pattern, base), trigger in zip(NAME_CONTEXTS, NAME_TRIGGERS, strict=True):
            if trigger.search(text):
                for m in pattern.finditer(text):
                    for s in self._name(text, m, base):
                        yield s
                        while s and s.score >= 1 and (m := _NEXT_NAME.match(text, s.end)):
                            s = next(self._name(text, m, 1.0 if m[0].startswith(" ") else 0.7), None)
                            if s:
                                yield s
        if self.known:
            for pattern in WEAK_NAMES:
                for m in pattern.finditer(text):
                    if self._may_be_known(m[1]):
                        yield from self._name(text, m, 0.2, weak=True)

    def _may_be_known(self, name: str) -> bool:
        """False only if the first part that counts begins as no known part does: then not all parts are known."""
        if name[:2].casefold() in self.beginnings:
            return True
        words = name.split()
        while len(words) > 1 and words[0].rstrip(",") in _LATIN_STOP:
            del words[0]
        return next((w[:2].casefold() in self.beginnings for w in name_parts(" ".join(words))), False)

    def _name(self, text: str, m: re.Match, base: float, weak: bool = False) -> Iterator[Span]:
        start, end = m.span(1)
        name = m[1]
        words = name.split()
        while len(words) > 1 and words[0].rstrip(",") in _LATIN_STOP:
            start += len(words[0]) + 1
            name = text[start:end]
            words = name.split()
        if not name or words[0] in _LATIN_STOP or _NOT_NAMES.match(name):
            return
        if self.known and re.fullmatch(r"[ぁ-んー]+", words[-1]) and words[-1] not in self.known:
            # hiragana runs on into what follows the name
            cut = next((k for k in range(len(words[-1]) - 1, 1, -1) if words[-1][:k] in self.known), len(words[-1]))
            end -= len(words[-1]) - cut
            name = text[start:end]
        score = base
        if base == 0.7 and re.fullmatch(r"[一-鿿々]{3,5}|[一-鿿々]{1,3} [一-鿿々]{1,3}|[ァ-ヶー]+ [ァ-ヶー]+", name) and not _NO_PERSON.search(name):
            score += 0.3  # the shape of a full name
        if _COMPANY_BEFORE.search(text[max(0, start - 6) : start]) or _COMPANY_AFTER.match(text, end):
            score -= 1.5
        if self.known:
            support = self._support(name)
            score += 0.9 if support == 1 else 0.3 if support > 0 and not weak else 0.0
        yield Span(start, end, "name", score)

    def lookups(self, text: str) -> set[str]:
        """All strings that `names` can ask any lexicon for, of folded text: parts of proposals, their beginnings and ends."""
        asked: set[str] = set()
        for pattern, trigger in [*zip((p for p, _ in NAME_CONTEXTS), NAME_TRIGGERS, strict=True), *((p, None) for p in WEAK_NAMES)]:
            if trigger is None or trigger.search(text):
                for m in pattern.finditer(text):
                    for part in name_parts(m[1]):
                        asked.add(part)
                        if not part.isascii():
                            asked.update(part[:k] for k in range(2, len(part)))
                            asked.update(part[k:] for k in range(1, len(part) - 1))
        return asked

    def _support(self, name: str) -> float:
        """Share of the name that the lexicon knows as parts."""
        parts = name_parts(name)
        if not parts:
            return 0.0
        hit = sum(self._covers(p) for p in parts)
        return hit / len(parts)

    def _covers(self, part: str) -> bool:
        if part in self.known:
            return True
        return not part.isascii() and any(part[:k] in self.known and part[k:] in self.known for k in range(1, len(part)))

    @staticmethod
    def _near(words: re.Pattern, text: str, m: re.Match, before: int, after: int) -> bool:
        left = text[max(0, m.start() - before) : m.start()]
        left = left[max(left.rfind("\n"), left.rfind("。")) + 1 :]
        right = re.split(r"[\n。]", text[m.end() : m.end() + after], maxsplit=1)[0]
        return bool(words.search(left) or words.search(right))

    # -- all --

    def spans(self, text: str | None) -> list[Span]:
        if not text:
            return []
        plain = folded(text)
        blocked = [m.span() for m in LINK.finditer(plain)]
        found = [s for f in (self.emails, self.phones, self.id_numbers, self.addresses, self.names) for s in f(plain) if s.score >= 1]
        found.sort(key=lambda s: (-s.score, s.start - s.end, s.start))
        taken: list[Span] = []
        for s in found:
            if all(s.start < a or b <= s.start for a, b in blocked) and all(s.end <= t.start or t.end <= s.start for t in taken):
                taken.append(s)
        return sorted(taken)

    def redacted(self, text: str | None) -> str | None:
        """The text with a typed placeholder for every mention; null stays null."""
        return None if text is None else self.replaced(text, self.spans(text))

    @staticmethod
    def replaced(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for s in spans:
            out += [text[at : s.start], PLACEHOLDERS[s.kind]]
            at = s.end
        return "".join([*out, text[at:]])


# -- over tables ---------------------------------------------------------------------------


def name_lexicon(df: DataFrame, text: str) -> DataFrame:
    """(part, n) of name parts in telling contexts, with the documents that have each; those of LEAST_DOCUMENTS."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                plain = folded(t)
                own = set()
                for s in finder.names(plain):
                    if s.score >= 1:
                        own.update(name_parts(plain[s.start : s.end]))
                counts.update(own)
            yield pa.record_batch({"part": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = df.where(df[text].isNotNull()).select(df[text].alias("text"))
    counted = rows.mapInArrow(parts, "part STRING, n BIGINT").groupBy("part").agg(F.sum("n").alias("n"))
    return cut_lineage(counted.where(F.col("n") >= LEAST_DOCUMENTS))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, part) of batches (h, text): what each text asks the lexicon for."""
    finder = Finder()
    hashes: list[int] = []
    parts: list[str] = []
    for batch in batches:
        for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            own = finder.lookups(folded(t))
            hashes += [h] * len(own)
            parts += own
            if len(parts) > 50_000:
                yield pa.record_batch({"h": pa.array(hashes, pa.int64()), "part": pa.array(parts, pa.string())})
                hashes, parts = [], []
    yield pa.record_batch({"h": pa.array(hashes, pa.int64()), "part": pa.array(parts, pa.string())})


def _with_finders(rows: DataFrame, work: Callable[[pa.RecordBatch, Iterable[Finder]], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` over batches of rows (key, text) without nulls, with finders for their texts that know the lexicon.

    A small lexicon is broadcast. Else every text gets the parts of it that it can ask for, by a
    join; texts are told apart by hash, and where two share one, parts more do no harm.
    """
    lexicon = name_lexicon(rows, "text")
    if lexicon.count() <= BROADCAST_PARTS:
        known = rows.sparkSession.sparkContext.broadcast({r["part"]: r["n"] for r in lexicon.toLocalIterator()})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(known.value)
            for batch in batches:
                yield work(batch, repeat(finder))

        return rows.mapInArrow(whole, schema)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch, (Finder(dict.fromkeys(parts or (), LEAST_DOCUMENTS)) for parts in batch.column("parts").to_pylist()))

    hashed = rows.withColumn("h", F.xxhash64("text"))
    asked = hashed.select("h", "text").mapInArrow(_asked, "h BIGINT, part STRING").join(lexicon.select("part"), "part")
    return hashed.join(asked.groupBy("h").agg(F.collect_set("part").alias("parts")), "h", "left").mapInArrow(own, schema)


def annotated_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, spans, redacted) of every row: its mentions, array of (kind, start_pos, end_pos, score), and the text with typed placeholders.

    Positions are in code points from 0. A null text has no mentions and stays null. The lexicon
    of names is learned once, then one pass over the texts gives both.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))

    def annotate(batch: pa.RecordBatch, finders: Iterable[Finder]) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        lists = [f.spans(t) for t, f in zip(texts, finders)]
        flat = [s for x in lists for s in x]
        fields = [pa.array([s.kind for s in flat], pa.string()), pa.array([s.start for s in flat], pa.int32()), pa.array([s.end for s in flat], pa.int32()), pa.array([s.score for s in flat], pa.float64())]
        offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["kind", "start_pos", "end_pos", "score"]))
        return pa.RecordBatch.from_arrays([batch.column("key"), spans, pa.array([Finder.replaced(t, x) for t, x in zip(texts, lists)], pa.string())], ["key", "spans", "redacted"])

    kind = rows.schema["key"].dataType.simpleString()
    found = _with_finders(rows.where("text is not null"), annotate, f"key {kind}, spans ARRAY<STRUCT<kind: STRING, start_pos: INT, end_pos: INT, score: DOUBLE>>, redacted STRING")
    none = rows.where("text is null").select("key", F.array().cast(found.schema["spans"].dataType).alias("spans"), F.col("text").alias("redacted"))
    return found.unionByName(none).withColumnRenamed("key", key)


def mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos, score) of every mention. Repeated rows give repeated mentions."""
    return annotated_texts(df, key, text).select(key, F.explode("spans").alias("s")).select(key, "s.*")


def redacted_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with typed placeholders; null texts stay null."""
    return annotated_texts(df, key, text).select(key, F.col("redacted").alias("text"))
