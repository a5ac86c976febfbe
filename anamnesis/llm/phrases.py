"""Word lists of the defect rules, for eight languages. All are fixed values.

Patterns are matched on folded text: lower case, without accents, marks as blanks.
"""

from __future__ import annotations

#: Frequent function words, folded; a word may belong to several languages.
FUNCTION_WORDS = {
    "en": "the a an of to and in is was were are be been that this these those it its for with as on by at from not but or if when which what who how why should would can could did do does have has had we you i they he she there their our your than then so they still more most all any before after during about into only also because until where will",
    "de": "der die das den dem des ein eine einen einem einer und in ist war waren sind sein zu von mit fur auf nicht aber oder wenn als wie was wer warum wo soll sollte kann konnte haben hat hatte wir ihr ich sie er es im am zum zur vor nach wahrend uber nur auch weil bis noch mehr alle bei aus an dass sich wird wurde wurden hier doch schon kannst habe damit darf",
    "es": "el la los las un una unos unas y de del en es fue son ser que este esta estos estas para con como por no pero o si cuando cual quien por al se lo le su sus mas muy todo todos antes despues durante sobre solo tambien porque hasta donde ya hay ha han nos hemos conviene puedes queda quedan que ni mi me donde cuantas cuantos casi",
    "fr": "le la les un une des du de et en est etait etaient sont etre que qui ce cet cette ces pour avec comme par ne pas mais ou si quand quel quelle au aux se son sa ses leur leurs plus tres tout tous avant apres pendant sur seulement aussi car parce jusqu ou a ont nous vous je il elle on y dans faut dit disent combien pourquoi peux avons d l qu n s c",
    "nl": "de het een en van in is was waren zijn te met voor op niet maar of als wanneer wat wie waarom waar hoe moet zou kan kon kun hebben heeft had we wij jij ik ze zij hij er om naar bij uit aan dat die dit deze zich wordt werd nog meer alle ook omdat tot tijdens over na dan toen wel eens al al je mij hun ons onze hoeveel daar geen",
    "pt": "o a os as um uma uns umas e de do da dos das em no na nos nas ao aos que este esta esse essa isso para com como por nao mas ou se quando qual quem seu sua seus suas mais muito todo todos antes depois durante sobre so tambem porque ate onde ja ha foi foram sao ser tem temos voce pode ficaram fica quase quantos quantas dizem pelo pela",
}

#: Letters that speak for a language, in lower case, and how many function words each is worth.
LETTERS = {
    "es": ("¿¡ñ", 3, "áíóú", 1),
    "pt": ("ãõ", 3, "çáâêôà", 1),
    "de": ("ßäöü", 2, "", 0),
    "fr": ("èêîûœùëï", 2, "çàâôé’", 1),
    "nl": ("ĳ", 3, "", 0),
}

#: What a language is called, folded, in the eight languages; for questions that ask for one.
LANGUAGE_NAMES = {
    "en": "english englisch ingles anglais engels 英语 英文 英語",
    "de": "german deutsch aleman allemand duits alemao 德语 德文 ドイツ語",
    "es": "spanish spanisch espanol espagnol spaans espanhol castellano 西班牙语 西班牙文 スペイン語",
    "fr": "french franzosisch frances francais frans 法语 法文 フランス語",
    "ja": "japanese japanisch japones japonais japans 日语 日文 日本語",
    "nl": "dutch niederlandisch neerlandes holandes neerlandais nederlands hollandais 荷兰语 荷兰文 オランダ語",
    "pt": "portuguese portugiesisch portugues portugais portugees 葡萄牙语 葡萄牙文 葡语 ポルトガル語",
    "zh": "chinese chinesisch chino chinois chinees chines 中文 汉语 漢語 中国語 普通话",
}

#: An answer that consists of these alone says nothing.
PLACEHOLDERS = (
    "null none nil nan na n a undefined empty tbd todo pending placeholder no content no response no output blank unknown error "
    "leer keine vacio nulo vide aucun leeg geen vazio nenhum 无 空 空白 暂无 なし 無し 未定"
)

#: A sentence that matches one of these declines, or states that there is no answer.
REFUSALS = (
    # English
    r"^(i m |i am |we re |we are )?(so |very |really )?(sorry|afraid)( about that)?( but)?( no)?( i| we)?( really)? ?(can ?t|cannot|can not|won t|will not|am not able to|am unable to|must|have to|don t|do not|couldn t)\b",
    r"^(sorry|apologies)( but)? no$",
    r"^sorry i (can|won|do|am)\b",
    r"\b(i|we) (can ?t|cannot|can not|won t|will not|am not able to|m not able to|am unable to|are unable to|won t be able to|will not be able to)( be able to)? (help|assist|answer|discuss|provide|tell you|talk about|share|comply|comment|say|do that|support|fulfil+|respond|offer|address)\b",
    r"\b(i|we) (must|have to|need to|would rather|prefer to) (respectfully |politely )?(decline|refuse|pass|turn this down|turn that down|not answer)\b",
    r"\bsomething (i|we) (have|need) to decline\b|\bmust pass on this\b|\brespectfully (decline|turn)\b",
    r"\b(against|violates?|goes against|not allowed by) (my|our|the) (guidelines|rules|policy|policies|programming)\b",
    r"\boutside (of )?(what i|my|the scope)\b.*\b(allowed|permitted|scope|can)\b|\bnot (allowed|permitted) to (talk|discuss|answer|say|share)\b",
    r"^(there is |i have |we have )?no (answer|reply|response|information)( available| to that| to this| found| for this| for that)?$",
    r"\bi (do not|don t) (know|have (an|the|any) (answer|information))\b|\b(cannot|can t|can not|could not|couldn t) (be answered|answer( this| that)?)\b",
    r"^as an (ai|assistant|artificial)\b.*\b(can ?t|cannot|must|not|unable|pass)\b",
    r"\b(reply|answer|response)( from me)? is not possible\b|\bnot (possible for me|in a position) to\b",
    # German
    r"\bantwort\b.*\bnicht moglich\b",
    r"\b(tut mir leid|bedau?re|entschuldigung|sorry)\b.*\b(nicht|kein|keine)\b",
    r"\b(kann|darf|mochte|will|werde) (ich |wir )?(\w+ ){0,6}(nicht|nichts|kein|keine)( \w+){0,3} ?(helfen|sagen|beantworten|aussern|sprechen|auskunft|geben|behandeln|weiterhelfen|unterstutzen|mitteilen)\b",
    r"\b(darf|kann) ich (leider )?(dazu |daruber )?keine (auskunft|angaben|antwort)\b",
    r"\bdaruber (darf|kann|mochte) ich\b.*\b(keine|nicht|nichts)\b|\bdazu mochte ich mich nicht\b|\b(muss|mochte) ich (leider )?(ablehnen|passen)\b|\banfrage (muss|kann) ich\b.*\b(ablehnen|nicht)\b",
    r"\buber .{1,80} (darf|kann) ich nichts sagen$|^keine antwort$|^dazu (gibt es|habe ich) keine (antwort|angaben)$|^ich weiss es nicht$",
    # Spanish
    r"\bno (se me permite|me esta permitido|tengo permiso)\b",
    r"\b(lo siento|lamento|lamentablemente|perdona|disculpa)\b.*\bno (puedo|podemos|me es posible|es posible|se me permite)\b",
    r"^no (puedo|podemos|me es posible|se me permite) (decir|ayudar|responder|hablar|dar|comentar|contestar|facilitar|proporcionar)\b",
    r"^prefiero no (hablar|responder|tratar|comentar)\b|\bfuera de lo que (se me permite|puedo)\b|^(no hay|sin) respuesta$|^debo (rechazar|declinar)\b|\bno lo se$",
    # French
    r"\bne m est pas (permis|possible)\b|\bm est impossible de\b",
    r"\b(desole|navre|regrette|malheureusement|pardon)\b.*\b(ne (peux|puis|pouvons)|impossible|pas possible)\b",
    r"^je ne (peux|puis|suis) (pas|rien)?( en mesure de| autorise a)? ?(rien )?(dire|repondre|aider|parler|vous aider|t aider|fournir|donner|traiter|aborder|commenter)\b",
    r"^je prefere ne pas (aborder|parler|repondre|traiter)\b|\bdepasse ce que j ai le droit\b|^(pas de|aucune|sans) reponse$|^je dois (refuser|decliner)\b|\bje ne sais pas$",
    # Dutch
    r"\b(mag|kan)\b.{0,24}\bgeen antwoord\b",
    r"\b(spijt me|sorry|helaas|jammer)\b.*\b(niet|geen|niets)\b.*\b(helpen|behandelen|antwoorden|zeggen|bespreken|geven|beantwoorden)?",
    r"\b(praat|spreek) ik liever niet\b|\bover .{1,80} (kan|mag) ik (je |u )?(niets|niks|niet)\b.*|^(kan|mag) ik (niet|niets)\b|^ik (kan|mag|wil) (daar|je|u|hier)?\b.{0,60}\b(niets|niks|niet|geen)\b.{0,30}\b(zeggen|helpen|geven|vertellen|antwoorden|bespreken)\b|^(er is )?geen antwoord$|^ik weet het niet$",
    # Portuguese
    r"\bnao tenho (permissao|autorizacao)\b",
    r"\b(sinto muito|desculpe|desculpa|infelizmente|lamento)\b.*\bnao (posso|podemos|me e permitido|e possivel|consigo)\b",
    r"^nao (posso|podemos|me e permitido|consigo) (dizer|ajudar|responder|falar|dar|tratar|comentar|fornecer)\b|^prefiro nao (falar|responder|tratar|comentar)\b|\bfora do que (me e permitido|posso)\b|^(nao ha|sem) resposta$|^(tenho de|devo|preciso) recusar\b|\besta (fora|alem) do que\b.*\b(posso|permit)|^nao sei$",
    r"\bultrapassa o que\b.*\b(posso|permit)|\bessa pergunta\b.*\b(fora|alem|ultrapassa)\b",
)

#: Words of which every pattern of REFUSALS needs one, so that a sentence without any is not tried.
REFUSAL_WORDS = (
    "sorry afraid apologies cannot cant t not unable decline refuse pass down respectfully guidelines rules policy policies programming "
    "outside no ai assistant artificial nicht nichts kein keine ablehnen passen fuera sin rechazar declinar ne impossible pas depasse "
    "aucune sans refuser decliner geen niet niets niks nao fora sem recusar alem ultrapassa"
)

#: The same for Chinese and Japanese.
REFUSALS_CJK = (
    r"违反.{0,8}(准则|规定|规则|政策)|(只能|必须|只好|不得不)拒绝|規則により.*(できません|控え)",
    r"(抱歉|对不起|不好意思|很遗憾|遗憾).*(无法|不能|不可以|没办法|不便|不会)(协助|讨论|回答|提供|帮|透露|谈|说)?",
    r"^(我|我们)?(无法|不能|不便|没办法)(回答|提供|讨论|协助|透露|谈论|告诉)|不能提供(任何)?(信息|资料|内容)|超出了我(可以|能|所能)?.{0,6}(回答|讨论|处理)?.{0,4}范围|^(没有|无|暂无)(答案|回答|回复)$|^我不知道$|不在我.{0,8}范围|无可奉告",
    r"(申し訳|すみません|あいにく|残念).*(できません|ません|扱えない|いたしかねます|お答え|控え)",
    r"(お答え|お話し|お手伝い|回答|提供|お伝え)(は|が|を|も)?.{0,4}(できません|できかねます|控え|いたしかねます|差し控え)|についてはお話しできません|^(回答|答え)(は|が)?(なし|ありません)$|扱えない内容|^わかりません$",
)

#: A sentence that only goes with a refusal.
AFTER_REFUSAL = (
    r"^(please |kindly )?(try|ask|choose|pick)( me)?( a| an| another| some)* ?(different|another|other|else|something)\b.*$",
    r"^requests like (this|that|these)\b.*$|^(stell|frag|stelle|versuch)\w* .*\b(andere|anderes|anderen)\b.*$|^(prueba|intenta|haz|pregunta)\b.*\botra\b.*$|^(merci d en poser|posez|essayez|essaie)\b.*\bautre\b.*$",
    r"^(stel|probeer|vraag)\b.*\bandere\b.*$|^(tente|faca|experimente|pergunte)\b.*\boutra?\b.*$|^请?(换|问|试).*(问题|一个)吧?$|^(別|ほか|他)の.*(ください|どうぞ)$",
    r"^(thank you|thanks) for (asking|the question|your question|your interest)\b.*$|^danke (fur die|fur deine|fur ihre|der) (frage|nachfrage)\b.*$|^gracias por (preguntar|la pregunta|tu pregunta|su pregunta)\b.*$",
    r"^merci (pour|de) (la |votre |ta )?question\b.*$|^obrigad[oa] (por perguntar|pela pergunta)\b.*$|^(bedankt|dank je|dank u) voor (de|je|uw) vraag\b.*$|^(谢谢|感谢)(你|您)?的?(询问|提问|问题|问).*$|^.*についてのご質問(です|ありがとうございます).*$",
    r"^(and )?(i|we) hope you understand$|^ich bitte um verstandnis$|^so i (will|ll) leave it there$|^(i m |so )?sorry( about that)?$|^(lo siento|desole|es tut mir leid|het spijt me|sinto muito|抱歉|对不起|申し訳ありません|すみません)$",
)

#: What frames a question that is given back, folded, before it.
ECHO_FRAMES = (
    r"(you|u) (asked|asked me|wanted to know|want to know|said|wrote)( whether| if| about)?",
    r"(your|the) (question|request)( is| was| reads)?|so (you|your) .{0,30}|question|q|repeating( your question)?|to repeat( your question)?|let me repeat( your question)?",
    r"(du|sie|ihr) (hast|haben|habt|wolltest|wollten) (gefragt|wissen|geschrieben)|(deine|ihre|die) frage( lautet| war| ist)?|frage",
    r"(preguntaste|pregunto|has preguntado|preguntas|querias saber)( si)?|(tu|su|la) pregunta( es| era| fue)?|pregunta",
    r"(vous avez|tu as|vous m avez) (demande|ecrit)( si)?|(votre|ta|la) question( est| etait)?|question",
    r"(je|u) (vroeg|hebt gevraagd|heeft gevraagd|wilde weten)|(je|uw|de) vraag( is| was| luidt)?|vraag",
    r"(voce|tu) (perguntou|perguntaste|quis saber)|(sua|a sua|a tua|a) pergunta( e| era| foi)?|pergunta",
    r"(你|您)(的)?(问题|提问)(是|为)?|(你|您)(刚才)?(问|想知道)(的是|了|道|我)?|问题(是)?|(ご)?(質問|お尋ね|ご質問)(は|の内容は|内容)?(次のとおり(です)?|こちら(です)?|以下のとおり(です)?)?|(あなた|お客様)(は|の)(質問|お尋ね)(は|に)?|お尋ねは|お尋ねの件",
)

#: Openings that say nothing of the language of what follows, folded; matched as a whole first sentence or up to a colon.
OPENINGS = (
    r"(sorry|entschuldige|entschuldigung|perdona|perdon|desole|sorry voor|desculpe|desculpa|thank|thanks|danke|gracias|merci|bedankt|dank|obrigad)\b.{0,60}",
    r"(抱歉|对不起|谢谢|感谢|不好意思|让你久等|お待たせ|すみません|申し訳|ありがとう).{0,24}",
    r"(sure|of course|certainly|gladly|gern|gerne|naturlich|claro|por supuesto|bien sur|volontiers|natuurlijk|graag|claro que sim|com certeza|好的|当然|当然可以|もちろん|はい|承知しました)",
)
