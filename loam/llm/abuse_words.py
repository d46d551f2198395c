"""Words by which abusive, hateful and sexually explicit language is told in five languages, folded (lower
case, no accents). These lists are what documents are scored by; they are not an expression of opinion. How the words
must stand to each other is in ``abuse``."""

#: nouns that insult the person they are said to
INSULTS = set("""
idiot idiots moron morons imbecile imbeciles cretin cretins scumbag scumbags bastard bastards parasite parasites dirtbag asshole
assholes arsehole bitch bitches whore cunt dickhead douchebag jerk swine wanker motherfucker twat dumbass prick lowlife halfwit dimwit
idiota idiotas imbecil imbeciles cabron cabrona gilipollas pendejo pendeja hijoputa mierda desgraciado desgraciada
escoria basura inutil payaso payasa capullo subnormal tarado estupido estupida
abruti abrutie connard connards connasse salaud salopard ordure enfoire encule batard dechet cretine minable debile raclure
trottel arschloch dreckskerl mistkerl wichser abschaum versager schwachkopf vollidiot hurensohn missgeburt drecksau
fotze hackfresse penner schwein dummkopf depp idioten
""".split())
#: nouns that insult only where a person is spoken to
MILD = set("loser losers trash garbage pig rat filth vermin worm clown fool failure dog dirt scum waste coward ratte muell abfall feigling perdedor cerdo basura rata porc cochon cloporte rat lache".split())
#: adjectives that demean the person they are said of
DEMEANING = set("stinking lousy stupid worthless useless pathetic disgusting spineless miserable ugly dumb brainless filthy rotten vile dumm nutzlos wertlos ekelhaft erbarmlich widerlich inutil miserable patetico asqueroso asquerosa despreciable nul nulle pitoyable degoutant minable miserables elender dreckiger dummer".split())
#: words that speak to a person; of another person
YOU = set("you youre yourself u ur ya thou du dich dir euch ihr bist tu te toi t vous es eres usted vos vosotros ti".split())
YOUR = set("your yours ur dein deine deiner deinen deinem eure euer ta ton tes votre vos tu tus su vuestro vuestra".split())
OTHERS = set("he she him her hes shes er sie ihn il elle lui el ella esse such what tel telle semejante so".split())
#: words that state what someone is
IS = set("are is am was were be being bist ist sind seid war es est sont etes eres es son sois soy call called".split())

#: verbs that hurt, as they are used of a person; participles
VIOLENCE = set("""
kill murder stab shoot strangle slit smash break punch beat beats burn hurt rip choke bash crush hang drown skin gut destroy hit slap kick hunt crack
tote toten umbringen bringe bring abstechen erschiessen verprugeln schlag schlage schlagen brech breche brechen zerschlage prugel hau
matar mato matare partir parto partire romper rompo golpear reventar reviento quemar pegar ahogar
tuer tue tuerai casser casse casserai frapper frappe crever egorger bruler defoncer eclater
""".split())
HURT = set("killed murdered stabbed shot strangled smashed broken punched beaten burned burnt hurt choked crushed hanged drowned skinned slapped kicked whipped raped gassed".split())
BODY = set("face teeth neck fingers finger legs leg bones bone skull head throat jaw ribs nose eyes knees arm arms mouth guts zahne fresse gesicht knochen hals beine nase kopf finger schadel gueule dents jambes tete os nez bras cou cara piernas dientes huesos cabeza boca cuello dedos nariz".split())
#: words that wish something; what is wished to someone; orders to die or to vanish
WISH = set("hope wish pray hoffe hoff wunsche espere souhaite ojala espero deseo".split())
DIE = set("die dies rot suffer perish burn choke bleed stirbst verreckst krepierst stirb verrecke krepiere verreck krepier creve creves meurs crever mourir mueras muerete muere pudrete pudras".split())
PLUNGE = set("bridge roof cliff building window brucke dach pont toit puente tejado".split())
HOLE = set("hole ditch gutter cave loch graben trou caniveau agujero zanja cueva sewer grave".split())
GO = set("go jump crawl geh spring kriech va retourne vete tirate saute return get".split())
#: words of rejection
NOBODY = set("nobody noone no-one keiner niemand personne nadie everyone everybody jeder alle".split())
LOVE = set("wants want likes like needs need loves love misses will mag braucht veut aime quiere necesita hates hate hasst deteste odia".split())
#: parts of orders to be silent
SILENCE = [("shut", "up"), ("shut", "your", "mouth"), ("halt", "maul"), ("halt", "fresse"), ("halts", "maul"), ("halt", "klappe"), ("ferme", "gueule"), ("ferme", "bouche"), ("ta", "gueule"), ("cierra", "boca"), ("cierra", "pico"), ("callate",)]

#: what a hated group is called; what is demanded for it; words of necessity
DEHUMAN = set("vermin rats rat cattle animals beasts subhuman subhumans plague thieves criminals cockroaches disease scum parasites cancer filth pest insects pigs dogs ungeziefer parasiten ratten diebe abschaum untermenschen pest tiere verbrecher plaga ratas ladrones parasitos animales criminales escoria vermine voleurs rats animaux criminels cafards racaille".split())
EXPEL = set("thrown deported burned burnt exterminated eradicated driven gassed expelled removed wiped hunted banned chased rausgeworfen raus verjagt vertrieben vernichtet ausgerottet abgeschoben echarlos expulsarlos quemarlos echar expulsar eliminarlos dehors chasser chasses expulser expulses exterminer virer eliminar".split())
MUST = set("should must ought need needs deserve let sollten sollte mussen gehoren gehort muss hay deben deberian devraient doivent faut keep never only".split())
HUMAN = set("human humans people menschen mensch humanos personas humains".split())
RIGHTS = set("rights rechte derechos droits droit respect mercy".split())
DENIED = set("no not never none keine keinen nicht nie aucun ne pas jamais ningun ninguno arent".split())
DESERVE = set("deserve deserves verdienen merecen meritent have haben tienen ont".split())
PLACES = set("country schools school town city streets land neighbourhood nation europe hospitals jobs".split())
BREED = set("breed multiply spread vermehren reproducen reproduisent".split())
ALL = set("all every each alle jeder tous toutes todos todas only those these".split())
BLOOD = set("blood nature birth race blut natur sang nature sangre naturaleza kind breed".split())
GROUPS = set("they them their immigrants foreigners refugees migrants auslander einwanderer fluchtlinge inmigrantes extranjeros refugiados immigres etrangers refugies".split())

#: sexually explicit words by weight: two points make a sentence explicit
STRONG_SEX = set("""
porn porno pornos xxx blowjob blowjobs cumshot gangbang handjob dildo slut sluts milf tits titties pussy boobs panties horny nudes fucks fucking fucked orgasm orgy
cum cumming nacktbilder nacktbild ficken fick gefickt titten muschi geil geile geilen pornos schlampe schlampen
salope salopes baiser baise nichons porno chatte
follar follamos folla tetas polla cono porno puta putas zorra
""".split())
WEAK_SEX = set("""
fuck cock dick sex sexy naked nude nudity moaning moan strip stripped stripping erotic wet hardcore uncensored webcam aroused undress undressed lick licking suck sucking thrust begged begging bedroom ass butt nipples
nackt nackte nackten nackter weiber weibern schwanz stohnen sexy ausgezogen
nue nues nu bite seins poil gemir deshabille deshabillee sexe
desnuda desnudas desnudo pelotas gemir caliente sexo cachonda tias
""".split())
#: words that make such language explicit beside a weak word: pictures that are asked for, bodies
PICTURES = set("send pics pictures photos photo fotos foto bilder envoie envoyer envoi mandame manda enviame schick schicke videos video movies camera camara kamera".split())
TOUCH = set("body bodies hard top bed desk tongue lips thighs legs korper corps cuerpo me you her him off".split())
#: words with which such language is talked about
ABOUT = set("""
word words term terms slur slurs insult insults offensive definition means meaning quoted quote removed filter policy moderator moderators moderation study
research health screening education exam clinic clinical museum novel law legal court medical cancer patient doctor biology species wildlife translation dictionary
wort worter begriff beleidigung beleidigungen richtlinie moderation studie gericht arzt roman gesundheit vorsorge
mot mots terme insulte insultes moderation etude sante depistage roman tribunal medecin
palabra palabras termino insulto insultos moderador politica estudio salud novela tribunal medico
""".split())

#: Chinese: insults, words that speak to a person, demands against groups, explicit words
CHINESE_INSULTS = ["白痴", "蠢货", "废物", "人渣", "贱货", "傻逼", "混蛋", "贱人", "王八蛋", "畜生", "垃圾", "蠢猪", "笨蛋"]
CHINESE_PERSON = ["你", "滚开", "闭嘴", "去死", "滚蛋"]
CHINESE_ORDERS = ["去死", "闭嘴吧", "滚出去", "杀了你", "打断你", "弄死你"]
CHINESE_HATE = ["害虫", "寄生虫", "不配做人", "都该死", "全部赶走", "都是小偷", "赶出去", "劣等", "低等", "都是垃圾"]
CHINESE_SEXUAL = ["裸照", "色情", "做爱", "淫荡", "黄片", "性交", "骚货", "裸体"]
CHINESE_ABOUT = ["政策", "删除", "定义", "研究", "审核", "举报", "教育", "筛查", "小说", "意思"]
