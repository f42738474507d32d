"""Pages written by hand, in languages and layouts the page model wasn't fitted on, with the lines of their bodies."""

OWN = {
"pl": ("""<!DOCTYPE html><html><head><title>Latarnia</title></head><body>
<header><div class="logo"><a href="/">Gazeta Nadmorska</a></div>
<nav><ul><li><a href="/a">Start</a></li><li><a href="/b">Kultura</a></li><li><a href="/c">Sport</a></li><li><a href="/d">Kontakt</a></li></ul></nav></header>
<main><article>
<h1>Stara latarnia znów świeci</h1>
<p>Po dwudziestu latach przerwy latarnia na północnym cyplu została ponownie uruchomiona przez miejskich konserwatorów.</p>
<p>Mieszkańcy zebrali się wieczorem na molo, aby zobaczyć pierwszy błysk światła, które widać nawet z sąsiedniej wyspy.</p>
<h2>Remont trwał trzy lata</h2>
<p>Najtrudniejsza okazała się naprawa soczewki, którą trzeba było sprowadzić z zagranicy i dopasować na miejscu.</p>
</article></main>
<aside><h3>Zobacz też</h3><ul><li><a href="/1">Nowy most nad zatoką</a></li><li><a href="/2">Targi książki w maju</a></li><li><a href="/3">Koncert w parku</a></li></ul></aside>
<footer><p>Wszelkie prawa zastrzeżone 2024</p><p><a href="/r">Regulamin</a> | <a href="/p">Prywatność</a></p></footer>
</body></html>""", {4, 5, 6, 7, 8}),
"it": ("""<html><body>
<div id="top"><a href="/">Il Faro</a> <a href="/cronaca">Cronaca</a> <a href="/meteo">Meteo</a> <a href="/cerca">Cerca</a></div>
<div class="content">
<h1>Il mercato torna in piazza</h1>
<p>Dopo i lavori di restauro la piazza vecchia ospita di nuovo il mercato del sabato, con oltre sessanta banchi.</p>
<p>I commercianti si dicono soddisfatti, anche se alcuni chiedono più parcheggi e una fermata dell'autobus vicina.</p>
<p>Il sindaco ha promesso una risposta entro la fine dell'estate.</p>
</div>
<div class="side"><h4>I più letti</h4>
<a href="/x">Chiude la vecchia stazione</a><br>
<a href="/y">Vento forte sulla costa</a><br>
<a href="/z">La ricetta della nonna</a>
</div>
<div class="foot">Redazione - Pubblicità - Note legali</div>
</body></html>""", {3, 4, 5, 6}),
"fi": ("""<html><head><title>Silta</title></head><body><nav><a href="/">Etusivu</a><a href="/u">Uutiset</a><a href="/k">Kartta</a></nav>
<section class="post">
<h1>Vanha silta suljetaan talveksi</h1>
<p>Kaupunki sulkee vanhan puusillan marraskuun alusta, koska sen rakenteet eivät kestä lumen painoa ilman korjausta.</p>
<p>Jalankulkijat ohjataan uudelle sillalle, joka on rakennettu sata metriä alavirtaan vanhan viereen.</p>
<blockquote>Toivomme, että silta avataan taas keväällä, sanoo kaupungin insinööri.</blockquote>
</section>
<footer>© Paikallislehti<br><a href="/t">Tietosuoja</a> <a href="/e">Käyttöehdot</a></footer></body></html>""", {2, 3, 4, 5}),
"pt": ("""<html><body><div class="menu"><ul>
<li><a href="/">Início</a></li>
<li><a href="/noticias">Notícias</a></li>
<li><a href="/agenda">Agenda</a></li>
</ul></div>
<div class="texto">
<h1>O moinho da aldeia</h1>
<p>O moinho foi construído no século dezoito por dois irmãos que vieram do norte à procura de trabalho.</p>
<p>Durante muitos anos moeu o trigo de toda a região, até que uma cheia destruiu a roda e parte da parede.</p>
<p>Hoje é um pequeno museu aberto aos domingos.</p>
</div>
<div class="rodape"><p>Todos os direitos reservados</p></div></body></html>""", {6, 7, 8, 9}),
"sv": ("""<!doctype html><html><head><title>Båten</title></head><body>
<div class="wrap"><div class="topbar"><a href="/">Hem</a> | <a href="/nytt">Nytt</a> | <a href="/sok">Sök</a></div>
<div class="story"><h1>Båten som kom tillbaka</h1>
<p>När isen släppte i mars hittade fiskarna en gammal båt som ingen hade sett på över trettio år.</p>
<p>Den låg nästan hel på botten av viken, och i lådan under sätet fanns ännu nycklarna till ett skåp.</p>
</div>
<div class="more"><b>Läs mer</b><ul><li><a href="/1">Fisket i siffror</a></li><li><a href="/2">Vikens historia</a></li></ul></div>
<div class="bottom">Ansvarig utgivare: redaktionen</div></div></body></html>""", {2, 3, 4}),
"tr": ("""<html><body><nav><a href="/">Ana sayfa</a> <a href="/h">Haberler</a></nav>
<article><h1>Köyün yeni okulu</h1>
<p>Yıllardır beklenen okul binası bu sonbaharda öğrencilere kapılarını açtı ve ilk ders zili çaldı.</p>
<p>Öğretmenler, eski binada kışın ısınmanın çok zor olduğunu, yeni sınıfların ise aydınlık ve sıcak olduğunu söylüyor.</p>
</article>
<footer>Tüm hakları saklıdır</footer></body></html>""", {1, 2, 3}),
"nl": ("""<!DOCTYPE html>
<html lang="nl"><head><title>De molen</title><style>p{margin:0}</style></head>
<body class="home">
<div id="kop"><span>Dorpskrant</span> <a href="/">Voorpagina</a> <a href="/agenda">Agenda</a> <a href="/contact">Contact</a></div>
<table><tr><td>
<ul>
<li><a href="/a">Archief</a></li>
<li><a href="/b">Verenigingen</a></li>
<li><a href="/c">Foto's</a></li>
</ul>
</td><td>
<h1>De molen draait weer</h1>
<p>Na een lange winter vol reparaties draaien de wieken van de oude korenmolen eindelijk weer in de wind.</p>
<p>De molenaar bakt elke zaterdag brood van eigen meel, en wie wil mag meehelpen met het kneden van het deeg.</p>
<p>Kinderen mogen gratis naar binnen.</p>
</td></tr></table>
<p>Dorpskrant - alle rechten voorbehouden</p>
</body></html>""", {11, 12, 13, 14}),
"cs": ("""<html><body>
<header>
<a href="/">Zprávy z údolí</a>
<nav>
<a href="/kultura">Kultura</a>
<a href="/sport">Sport</a>
<a href="/pocasi">Počasí</a>
</nav>
</header>
<main>
<h1>Nová lávka přes řeku</h1>
<p>Obec otevřela novou lávku, která spojuje nádraží se školou a zkracuje cestu dětem o celý kilometr.</p>
<h2>Stavba trvala rok</h2>
<p>Dělníci museli přerušit práci kvůli jarní povodni, která odnesla část lešení a poškodila základy.</p>
<blockquote>Bez pomoci sousedů bychom to nezvládli, řekl starosta při otevření.</blockquote>
</main>
<aside>
<h3>Nejčtenější</h3>
<ol>
<li><a href="/1">Zavřená pekárna</a></li>
<li><a href="/2">Výstava obrazů</a></li>
<li><a href="/3">Sběr papíru</a></li>
</ol>
</aside>
<footer>
<small>Kontakt | Inzerce | Ochrana údajů</small>
</footer>
</body></html>""", {10, 11, 12, 13, 14}),
"hu": ("""<html><head><title>A könyvtár</title></head><body>
<div class="cookie"><p>Az oldal sütiket használ a jobb élményért.</p><button>Rendben</button></div>
<div class="nav"><a href="/">Kezdőlap</a> &gt; <a href="/helyi">Helyi hírek</a></div>
<div class="cikk">
<h1>Megnyílt a felújított könyvtár</h1>
<div>Két év után újra kölcsönözhetnek könyveket a város lakói a főtéri épületben, ahol új olvasóterem is készült.</div>
<div>Az első napon több mint háromszáz látogató érkezett, és a gyerekek délután mesét hallgattak az udvaron.</div>
</div>
<div class="ajanlo"><strong>Olvassa el ezt is</strong>
<a href="/x">Új buszmegálló épül</a><br>
<a href="/y">Piac lesz szombaton</a><br>
</div>
<div class="lab">Impresszum - Adatvédelem - Kapcsolat</div>
</body></html>""", {4, 5, 6}),
}
