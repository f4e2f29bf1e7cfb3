"""Small dictionaries of function words, stand-ins and refusals."""

from __future__ import annotations

#: Common function words of each language written in Latin letters, without accents.
FUNCTION_WORDS = {
    "en": "yes me like one two first after back same very so just been being up out him them us own other another such if because though through down off does done make made came come went go get got take took see used using the of and to in is it that which what who how why do did not for on with as was were are be has have had from by at or but this these those he she his her its their they you your i my we our an will would should could than then when where while there about into over before between without ever again most only more every each nobody according",
    "fr": "personne moins pouvait croyait environ toujours tres bien tout tous toute toutes meme aussi encore entre sous contre depuis pendant non oui si mon ma mes ton votre notre quelque chaque autre autres elle cette t le la les l un une des du de d et est dans que qui quoi quel quelle pour pas ne n ce cet ces il ils elles nous vous je j on sur avec par au aux son sa ses leur leurs mais ou donc plus comme quand selon apres avant chez sans etre avoir ete ont sont fait quels vers pourquoi comment",
    "de": "etwa alles alle selbst sehr zwischen gegen seit ja nein mein meine unser andere anderen vor wahrend bevor will diesem wurde der die das den dem des ein eine einen einem einer und ist nicht mit von zu im in auf fur sich dass wie was wer warum welche welchen welches als auch an aus bei nach um noch ich du er sie es wir ihr hat haben war wird werden wenn aber doch dort ohne uber nur kann zur zum niemand einmal diese dieser dieses laut",
    "es": "dos hacen hace todo todos toda mismo muy bien entre contra desde durante si mi mis tu tus nuestro otro otra otros otras despues antes mientras tiene tienen habia hasta cual cuales esta esto el la los las un una unos unas de del y en que es no se por para con su sus lo le al como mas pero o este ese esa aquel porque cuando donde quien yo ella nosotros han ha hemos ser fue son era sobre todavia aunque segun hacia junto sin nadie cada nunca",
    "it": "vogliono circa tutto tutti stesso molto bene fra tra contro durante si mio mia suoi nostro altro altra altri dopo prima mentre aveva fino ancora quale quali sua suo sue nello negli questa il lo la i gli le un uno una di del della dei delle degli e che non in con per su da dal dalla al alla ai ma come piu questo quello quella perche quando dove chi cui io lui lei noi hanno ha abbiamo essere sono era ci anche secondo verso senza mai ogni nessuno eppure nel nella",
    "pt": "tudo todos mesmo muito bem entre contra desde durante sim meu minha nosso outro outra outros depois antes enquanto tinha ate ainda vez vezes qual quais nesta neste nessa deste desta como o a os as um uma uns umas de do da dos das e em no na nos nas que nao se por para com ao aos seu sua seus suas mas mais ou este esta isto esse essa porque quando onde quem eu ele ela foi sao era ser tem segundo sem nunca cada ninguem numa pela pelo ja aquele",
    "nl": "ongeveer alle zelf heel tussen tegen sinds ja nee mijn onze ander andere anders na voordat terwijl welk welke het de een en van in is dat niet op te zijn voor met die er aan als om door maar ook bij naar uit over heeft hebben had was wordt werd wat wie waarom hoe waar wil zou kan dit deze ik je hij zij wij ze nog dan of toen alles daar zonder volgens tijdens niemand tot blijft bleef",
    "pl": "okolo wszystko wszyscy bardzo dobrze miedzy przeciw tak moj moja nasz inny inne innych potem zanim podczas gdzie i w z na do nie sie jest ze to jak o po za od dla przez ktory ktora ktore ktorzy czy co kto dlaczego jaki jaka jakie jakim tym tego ten ta te ale oraz bez przy juz tylko byl byla bylo sa ma aby zeby kiedy gdy moze jego jej ich nawet nadal niz wiecej mniej nikt wciaz tej tam pod go przed chociaz",
}

#: Words with which no sentence of a language ends, with accents; words that may also be adverbs, pronouns or verb particles are left out. A low line joins two words. Those of Chinese
#: stand alone after a sign.
NEVER_LAST = {
    "en": "the a an and or but nor whose because although unless whereas whether than my your our their every and_not but_not",
    "fr": "le les un des du de et mais que qui dont car quand chez par cet cette ses leurs",
    "de": "dem des ein einem und oder aber dass weil wenn ob vom zum zur beim fürs",
    "es": "el los las un y o pero que porque cuando con sin por del de su sus",
    "it": "il lo gli un di del della e ma che quando con per dal nel nella",
    "pt": "o os as de do da dos das e ou mas que porque quando com sem por",
    "nl": "de een en of maar omdat wanneer",
    "pl": "i w z na do ale oraz że który która które gdy przez dla bez przed przy",
    "ru": "и в на с но который которая которое когда для без перед при по из от",
    "zh": "因为 但是 可是 而且 所以 虽然 如果 或者 并且",
}

#: Names by which a question asks for an answer in a language, without accents.
LANGUAGE_NAMES = {
    "en": "english anglais englisch ingles inglese engels angielsku angielski английск 英语 英文",
    "fr": "french francais franzosisch frances francese frans francusku francuski французск 法语 法文",
    "de": "german allemand deutsch aleman tedesco alemao duits niemiecku niemiecki немецк 德语 德文",
    "es": "spanish espagnol spanisch espanol spagnolo espanhol spaans hiszpansku hiszpanski испанск 西班牙语",
    "it": "italian italien italienisch italiano italiaans wlosku wloski итальянск 意大利语",
    "pt": "portuguese portugais portugiesisch portugues portoghese portugees portugalsku portugalski португальск 葡萄牙语",
    "nl": "dutch neerlandais niederlandisch neerlandes holandes olandese nederlands niderlandzku niderlandzki holenderski нидерландск голландск 荷兰语",
    "pl": "polish polonais polnisch polaco polacco polones pools polsku polski польск 波兰语",
    "ru": "russian russe russisch ruso russo russisch rosyjsku rosyjski русск 俄语 俄文",
    "zh": "chinese chinois chinesisch chino cinese chines chinees chinsku chinski китайск 中文 汉语",
}

#: What stands in an answer's place where there is none, once brackets and dots are taken off.
STAND_INS = frozenset(("na", "n a", "none", "null", "nil", "nan", "undefined", "empty", "blank", "no answer", "no response", "no reply", "no output", "missing", "tbd", "todo", "not available", "unanswered", "answer missing", "placeholder"))

#: How an answerer declines, in lower case without accents; the answerer speaks as "I" or "we". Before the patterns of a
#: language stand the words one of which each of them needs.
REFUSALS = {
    "en": ("i we my our me us prefer ai assistant", (
        r"\b(?:i|we) (?:really |simply |just |am afraid i |also )?(?:cannot|can ?not|can't|won't|will not|am unable to|am not able to|couldn't|am not going to|do not wish to|don't want to) (?:be able to )?(?:help|assist|answer|provide|respond|reply|share|discuss|comment|talk|speak|disclose|reveal|go into|speculate|comply|fulfil|address|offer|give (?:an answer|you)|say (?:anything|more)|do (?:that|this)|support|engage|take (?:that|this) on)\b",
        r"\b(?:i|we)(?: must| have to| need to| will| shall)? (?:respectfully |politely )?(?:decline|refuse|abstain)\b",
        r"\b(?:i|we) have to pass on\b",
        r"\b(?:i|we)(?:'d| would)? (?:rather|prefer) not\b",
        r"(?:^|[.!?:] )prefer not to\b",
        r"\b(?:is|are) not something (?:i|we) (?:will|would|can|want to|am willing to|am able to|take|discuss|talk|comment|answer)\b",
        r"\b(?:i|we) (?:have been|was|were|am) (?:asked|told|instructed) (?:to leave|not to)\b",
        r"\b(?:my|our) (?:guidelines|rules|instructions|policies|policy) (?:do not|don't|does not|doesn't|forbids?|prohibits?|prevents?|won't)\b",
        r"\bno comment from (?:me|us)\b",
        r"\b(?:i am|i'm|we are) not (?:comfortable|allowed|permitted|authori[sz]ed|at liberty|in a position|willing)\b",
        r"\bnot (?:be )?appropriate for (?:me|us)\b",
        r"\boff limits for (?:me|us)\b",
        r"\b(?:i|we) (?:do not|don't) (?:answer|discuss|comment on|respond to|talk about|take on|feel comfortable)\b",
        r"\bbeyond what (?:i|we) (?:am|are|can|may)\b",
        r"\bas an? (?:ai|language model|assistant)\b.{0,40}\b(?:cannot|can't|unable|not able)\b",
    )),
    "fr": ("je m", (r"\bje (?:ne peux|ne suis|refuse|prefere ne)\b(?! pas sur)", r"\bm'est impossible\b", r"\bce que je suis autorisee?\b", r"\bje suis desolee?\b")),
    "de": ("ich mich mir", (r"\bmochte ich mich\b.{0,20}\bnicht aussern\b", r"\b(?:darf|kann|mochte|will) ich\b.{0,30}\bnicht\b", r"\bich (?:darf|kann|mochte|will)\b.{0,40}\bnicht\b.{0,20}\b(?:helfen|beantworten|antworten|aussern|eingehen|sagen|dienen)\b", r"\bmir nicht moglich\b", r"\bes tut mir leid\b")),
    "es": ("siento puedo nos me prefiero estoy es", (r"\blo siento\b", r"\bno puedo (?:ayudar|responder|contestar|hablar|dar)\w*", r"\bno (?:me|nos) es posible\b", r"\bprefiero no\b", r"\bno estoy autorizad[oa]\b")),
    "it": ("posso possibile preferisco dispiace sono e", (r"\bnon posso (?:aiutar|rispond|fornir|parlar)\w*", r"\bnon (?:mi|ci) e possibile\b", r"\bpreferisco non\b", r"\bmi dispiace\b", r"\bnon sono autorizzat[oa]\b")),
    "pt": ("posso possivel prefiro lamento estou", (r"\bnao posso (?:ajudar|responder|falar|dar)\w*", r"\bnao me e possivel\b", r"\bprefiro nao\b", r"\blamento, mas\b", r"\bnao estou autorizad[oa]\b")),
    "nl": ("spijt ik liever mij", (r"\bhet spijt me\b", r"\bkan ik\b.{0,20}\bniet\b.{0,20}\bhelpen\b", r"\bliever niet\b", r"\bvoor mij niet mogelijk\b", r"\b(?:mag|kan|wil) ik\b.{0,30}\bniet\b.{0,20}\b(?:beantwoorden|zeggen|uitlaten|ingaan|antwoorden)\b")),
    "pl": ("przykro moge jestem wole wolno", (r"\bprzykro mi\b", r"\bnie moge (?:pomoc|odpowiedziec|udzielic|rozmawiac)\b", r"\bnie jestem w stanie\b", r"\bwole nie\b", r"\bnie wolno mi\b")),
    "ru": ("я предпочитаю имею извините мне", (r"\bя не (?:могу|имею возможности|буду|вправе)\b", r"\bя предпочитаю не\b", r"\bя? ?не имею возможности\b", r"\bизвините, но\b", r"\bмне не разрешено\b")),
    "zh": ("我 对 抱", (r"我(?:们)?(?:不能|无法|没有办法|没办法|不便|不可以|不愿|不想)", r"(?:对不起|抱歉)")),
}
