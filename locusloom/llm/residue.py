"""Template residue, filler, error pages and notices that stand in for content.

Two searches over whole texts:

* Messages. Multilingual phrases and words are matched by a multi-pattern automaton
  over the words of the text. A hit alone says little, since people quote such
  messages; so every sentence and line with a hit is judged by its coverage, in two
  ways. Phrases: a sentence or line is residue if it is covered by phrases to
  ``min_coverage`` and holds a telling one. Roles: whatever its wording, it is a
  notice if it names its subject (scripts, the browser, the page asked for, a text
  to come), says what is wrong with it or to be done about it, addresses the
  visitor where the kind of notice demands that, and consists to ``ROLE_COVERAGE``
  of the words such notices are made of. Coverage is taken of the sentence or line,
  not of the document, because real content around a message does not excuse it.
* Placeholders. Unfilled fields are matched by their delimiters, at any length
  within a paragraph, outside of code spans, quotations and sentences that explain
  a notation.

Defined cases: NULL and empty texts are clean; repeated texts are each reported;
texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

# ------------------------------------------------------------------ phrases
#
# One phrase a line; (a|b) stands for either, (a|) for an optional part, 9 for any
# number. Lines after "?" are weak: they count as covered but don't tell alone.

_PLACE = "(page|site|website|archive|viewer|application|app|portal|record|content|document|view|tool|database|browser|service|plot|map|catalogue|catalog|list|lines|table|collection|data|records|results|story|website|text)"
_CLIENT = "(browser|client|reader|viewer|device|web browser)"
_OFF = "(disabled|blocked|switched off|turned off|off|not enabled|not supported|not available|deactivated)"
_ENABLE = "(enable|activate|turn on|switch on|allow|permit)"
_JS = "(javascript|client side scripting|client side scripts|java script|js|scripts|scripting|active scripting|cookies|javascript and cookies|cookies and javascript|scripts and cookies|scripting and cookies)"

SCRIPT_NOTICES = f"""
{_JS} (is|are|seems to be|appears to be) {_OFF}
(looks like|seems that|appears that) {_JS} (is|are) {_OFF}
{_JS} (is|are|must be) (required|needed|necessary|enabled|allowed|switched on|turned on)
(please|kindly|you must|you need to|you have to|) {_ENABLE} {_JS}
enable js and disable any ad blocker
(please|) disable (any|your) ad blocker
if nothing (appears|happens|is shown|loads) (please|) {_ENABLE} {_JS}
to (continue|go on|proceed) (please|) {_ENABLE} {_JS}
(this|the) {_PLACE} (requires|needs) {_JS}
(does not|doesn t|cannot|can t|will not|won t) (work|run|start|load|open|function|be shown|be displayed) without {_JS}
(sorry but|are sorry but)
(you need|you have) to {_ENABLE} {_JS}
(the|this) {_PLACE} (could|can|may) not be (shown|displayed|loaded|opened)
because {_JS} (is|are) {_OFF}
if you (can read|can see|see|are reading|are seeing) this (text|line|message|page|sentence)
{_JS} (files|) (could|can) not be loaded
{_JS} (files|) (were|was|are|is) (not loaded|blocked|disabled|switched off|turned off)
your {_CLIENT} has (them|it|{_JS}) (switched|turned) off
your {_CLIENT} (does not|doesn t) support {_JS}
your {_CLIENT} (is|seems) (not|no longer) supported
your {_CLIENT} is (out of date|outdated|too old)
please (upgrade|update|change) it
please (upgrade|update|change) your {_CLIENT}
(checking|verifying) your {_CLIENT} before (opening|accessing|entering|showing|loading|you access|you enter)
just a moment
one moment please
checking (if|that|whether) (the|your) (site connection is secure|connection is secure|browser is supported)
(verifying|checking|verify) (that|) you are (a|) human
loading
loading please wait
(page|content|data|viewer|archive) is loading
please wait while (the|this|we|your)
bitte (aktivieren|erlauben) sie (javascript|scripte|skripte|cookies|javascript und cookies) (um (diese|die) (seite|anwendung|ansicht) (anzuzeigen|zu sehen|zu nutzen|zu verwenden)|)
(diese|die) (anwendung|seite|ansicht|website|webseite) (benötigt|erfordert|braucht) (javascript|skripte|cookies)
(javascript|skripte|cookies) (ist|sind) (in ihrem browser|) (deaktiviert|ausgeschaltet|abgeschaltet|blockiert)
javascript (ist|wird) (erforderlich|benötigt)
ihr browser wird (nicht|nicht mehr) unterstützt
ihr browser (wird|wurde) (überprüft|geprüft)
(seite|inhalt|daten) (wird|werden) geladen (bitte warten|)
wird geladen
bitte warten
veuillez (activer|autoriser) (javascript|les scripts|les cookies) (pour (afficher|voir|consulter|utiliser|ouvrir) (cette|la) (page|application|vue)|pour continuer|)
(ce site|cette page|cette application|cette vue) (nécessite|requiert|exige) (javascript|les scripts|les cookies|des cookies) (pour (fonctionner|s afficher)|)
javascript est (désactivé|requis|nécessaire|bloqué) (dans votre navigateur|)
votre navigateur n est (pas|plus) (pris en charge|compatible)
(chargement|chargement en cours) (veuillez patienter|)
veuillez patienter
vérification de votre navigateur
(active|active el|habilite|permita) (javascript|los scripts|las cookies) para (ver|usar|mostrar|abrir|continuar) (esta|la|) (página|aplicación|vista|)
(esta|la) (aplicación|página|web|vista) (requiere|necesita) (javascript|scripts|cookies) (para funcionar|)
(este|el) sitio (requiere|necesita) (javascript|scripts|cookies) (para funcionar|)
javascript está (desactivado|deshabilitado|bloqueado) (en su navegador|en tu navegador|)
(su|tu) navegador no es compatible
(cargando|cargando espere|espere por favor)
comprobando su navegador
"""

ERROR_MESSAGES = """
(error|http|http error|http status|erreur|fehler|estado|statut|status|code) 9
http 9 9 9
(error|) 9 (not found|forbidden|bad request|unauthorized|internal server error|bad gateway|service unavailable|gateway timeout|gateway time out|too many requests|request timeout|gone|method not allowed|service temporarily unavailable)
(page|file|document|record|url|resource) not found
not found
(access|permission) (denied|forbidden)
forbidden
unauthorized
bad request
(is|are) no longer available (on this server|)
(sorry|) we (could not|cannot|can t|couldn t) (deliver|find|open|show|load|display|serve) (that|the|your|this) (requested|) (page|record|address|resource|file|url|document|site)
(server|proxy|gateway|backend|site) (could not|cannot) (deliver|find|open|show|load|display|serve) (that|the|your|this) (requested|) (page|record|address|resource|file|url|document|site)
something (broke|failed|is broken)
too many connections in
bad gateway
gateway (timeout|time out)
internal server error
service (is|) (temporarily|) (unavailable|overloaded|down)
(this|the) (page|site|service|archive|server|record) is (temporarily|currently|) (unavailable|overloaded|down|not available)
temporarily (unavailable|overloaded)
too many requests
too many requests from your address (slow down|please slow down|try again later|)
(your|the) session (has|) (expired|timed out|ended)
session (expired|timed out|timeout)
(your|the) (login|connection|request) (has|) (expired|timed out)
(connection|request) (timed out|timeout|refused|reset|closed)
(login|sign in|log in|authentication) required
(please|) (sign|log) in (again|) to (continue|go on|proceed|view this page|see this record)
you (do not|don t) have (permission|access|the right) to (open|view|access|see|read) this (record|page|file|document|resource|site)
you are not (allowed|authorized|permitted) to (open|view|access|see|read) this (record|page|file|document|resource|site)
the (page|file|record|document|address|url|resource) you (asked for|requested|are looking for|were looking for|wanted) (does not exist|could not be found|was not found|cannot be found|has been moved|no longer exists) (or has been moved|or was moved|or has been removed|)
the (server|proxy|gateway|database|upstream server|site|service|application|host|backend|back end) (could not|cannot|was unable to|failed to|did not) (complete|process|handle|answer|serve|fulfil|fulfill|understand) (your|the) request
the (server|proxy|gateway|database|upstream server|site|service|application|host|backend|back end) (could not|cannot|was unable to|failed to|did not) (complete|process|handle|answer|serve|fulfil|fulfill|understand) (your|the) request in time
the (server|proxy|gateway|database|upstream server|site|service|application|host|backend|back end) (did not|does not) (answer|respond|reply) (in time|)
the (server|proxy|gateway|database|upstream server|site|service|application|host|backend|back end) (refused|closed|reset|dropped) the connection
the (server|proxy|gateway|database|upstream server|site|service|application|host|backend|back end) (returned|sent|gave) an (invalid|unexpected|empty) (response|answer|reply)
the (server|service|site|database) is (overloaded|busy|down|under maintenance|temporarily unavailable)
the (desired|requested|wanted) (page|resource|url|address|file|record|document) (could not|cannot|can not) be (retrieved|found|opened|loaded|reached|located) (on this server|)
the (desired|requested|wanted) (page|resource|url|address|file|record|document) (was not found|does not exist|is not available|is no longer available|has been removed|has been moved) (on this server|)
(something|oops something|sorry something) went wrong
an (unexpected|internal|unknown) error (has|) (occurred|happened)
(an|) error (occurred|has occurred)
error establishing a database connection
(briefly|temporarily) unavailable for (scheduled|planned|) maintenance
(this|your) account (has been|is|was) (suspended|locked|disabled)
(performance and|performance) security by cloudflare
application error a (server|client) side exception has occurred
application error
mysql connect too many connections
(we are|we re) (down|closed) for maintenance
(site|page|server|archive) under maintenance
(seite|datei|dokument) nicht gefunden
zugriff (verweigert|nicht erlaubt|nicht gestattet)
die (gewünschte|angeforderte|gesuchte) (seite|datei) (existiert nicht|wurde nicht gefunden|konnte nicht gefunden werden) (oder wurde verschoben|)
(der|die) (server|dienst|seite|datenbank|verbindung) (ist|wurde) (überlastet|nicht erreichbar|nicht verfügbar|vorübergehend nicht verfügbar|unterbrochen)
der (server|dienst) (antwortet nicht|hat nicht geantwortet)
dienst (nicht verfügbar|vorübergehend nicht verfügbar)
(interner|unerwarteter) (serverfehler|fehler|server fehler)
(ihre|die|) (sitzung|anmeldung) (ist|) (abgelaufen|beendet)
(zu viele anfragen|zeitüberschreitung|anmeldung erforderlich)
bitte melden sie sich (erneut|neu|wieder) an
es ist ein (unerwarteter|interner|) fehler aufgetreten
(etwas|leider) ist (etwas|) schiefgelaufen
page (introuvable|non trouvée|indisponible)
accès (refusé|interdit)
la page (demandée|recherchée) (n existe pas|est introuvable|n a pas été trouvée) (ou a été déplacée|)
(le|ce) (service|serveur|site) est (momentanément|temporairement|actuellement|) (indisponible|surchargé|inaccessible)
(le|) (serveur) (ne répond pas|n a pas répondu)
(service|serveur) (indisponible|surchargé|momentanément indisponible)
erreur interne (du serveur|)
(votre|la|) session (a expiré|expirée|est expirée)
veuillez vous (reconnecter|identifier à nouveau|connecter à nouveau)
(trop de requêtes|délai dépassé|connexion requise)
une erreur (s est produite|est survenue)
(página|archivo) no (encontrada|encontrado)
(acceso|permiso) denegado
la página (solicitada|pedida|buscada) no (existe|se encuentra|fue encontrada) (o fue movida|o ha sido movida|)
(el|) servidor (no responde|está sobrecargado|no está disponible)
(el|) servicio (no está disponible|no disponible|temporalmente no disponible)
error interno (del servidor|)
(la|su|tu|) sesión (ha caducado|ha expirado|caducada|expirada)
(inicie|inicia) sesión (de nuevo|otra vez) (para continuar|)
(demasiadas solicitudes|demasiadas peticiones|tiempo de espera agotado)
(ha ocurrido|se produjo) un error
algo (salió|ha salido) mal
"""

FILLERS = """
(replace|change|edit|overwrite|exchange) this (text|section|paragraph|sentence|line|box|block|part|page) (in the editor|here|)
(edit|change|replace) or delete it then start writing
add (one|two|a few|some|one or two|two or three) sentences (about|on)
(your|the) (figure caption|caption|content|text|story|article|news|post|body|copy|bio|profile|quote|entry|note|description|title|abstract|summary|paragraph|headline|name|introduction|section|table caption|heading|subtitle|figure|table|conclusion|methods|results) (goes|comes|will go|will come|belongs|will be|is to go|should go|will appear|appears) here
(type|write|enter|insert|put|paste|place|add) (your|the) (text|content|title|name|description|abstract|caption|summary|paragraph) here
(type|write|enter|insert|put|paste|place|add) (text|content|name|title|description|abstract|caption) here
click (here|) to (edit|add) (this|the|) (text|title|content|paragraph|)
(title|subtitle) of the (report|page|section|article|document)
name of the author
this (paragraph|text|section|block|line|sentence|page) only fills (space|the space|the page|room)
this (paragraph|text|section|block|line|sentence|page) (only|just) fills (space|the space|the page)
this is (only|just|) (dummy|sample|filler|placeholder|blind|example|demo|test) (copy|text|content) (to show the (layout|design|look) of the (page|site|section)|)
this (text|paragraph|section|content) is (only|just|) a (placeholder|filler|dummy)
(example|demo) (copy|text|paragraph|content|sentence)
(dummy|sample|filler|placeholder|blind|demo) (copy|text|paragraph|content|sentence)
blah blah blah
blah blah
(more|further|the) (text|content|details|information|words|copy) (will|to|is to) follow (soon|later|shortly|here|)
(more|details|information|text|content|description|further details) to (follow|come) (soon|later|shortly|here|)
(content|text|details|description|information|page|section|abstract) (for this (page|section|block)|) (is|are) (being|still being) (prepared|written|added)
(content|text|details|description|information|page|section|abstract) (for this (page|section|block)|) (is|are) (coming|coming soon|to follow|to be added|to be written|still to come|still missing)
(content|text|details|information|page|section|more|description) coming (soon|shortly|later)
(coming|more coming) (soon|shortly|later)
(to be|tba to be) (added|written|announced|completed|supplied|filled in|done|determined|provided) (soon|later|shortly|here|)
tbd
tba
under construction
(this|the) (page|site|section) is (still|) (under construction|empty|being built|being written|a stub)
just another (empty|blank) page (of|on) this site
(this|) (page|section) (is|) (intentionally|deliberately) left (blank|empty)
text text text
(test test|test) 9 (test|) please ignore
test test
please ignore this (test|page|text)
lorem ipsum
lorem ipsum dolor sit amet
asdf asdf
asdf
qwerty qwerty
jkl jkl
xxx xxx xxx
xxx xxx
heading (one|two|three|1|2|9)
body (copy|text)
(dies|das) ist (nur|) (ein|) (blindtext|platzhalter|platzhaltertext|fülltext|beispieltext|dummytext)
(blindtext|platzhaltertext|fülltext|beispieltext)
hier (steht|folgt|kommt|erscheint) (später|bald|demnächst|noch|) (der|ein|das) (richtige|endgültige|eigentliche|fertige|) (text|inhalt)
(text|inhalt|inhalte|beschreibung|weitere angaben|mehr) (folgt|folgen) (später|bald|in kürze|noch|)
(demnächst|bald|in kürze) (mehr|verfügbar)
(inhalt|text|seite) (wird|ist) (noch|derzeit|) (ergänzt|erstellt|in arbeit|im aufbau|in vorbereitung|vorbereitet)
(im aufbau|in bearbeitung)
hier entsteht (in kürze|demnächst|bald|) (eine|ein|unsere|unser|die) (neue|neuer|) (internetpräsenz|website|webseite|internetseite|homepage|internetauftritt|webauftritt)
texte de remplissage (à (remplacer|compléter) avant (la|) publication|)
(ceci est|voici) (un|du) (texte de remplissage|faux texte|texte provisoire)
(texte|contenu|description) (à venir|en cours de (rédaction|préparation)|provisoire|à compléter)
(bientôt disponible|à venir|en construction|à compléter)
(remplacez|modifiez) ce (texte|paragraphe) (par|avec) (votre|le) (texte|contenu|résumé)
texto de relleno (pendiente (del|de) (contenido|texto) (definitivo|final)|)
(este es|esto es) (un|) texto de (relleno|prueba|ejemplo)
(texto|contenido|descripción) (pendiente|provisional|en preparación|por definir|próximamente)
(próximamente|en construcción|por completar)
(reemplace|sustituya|cambie) este (texto|párrafo) (por|con) (su|el) (texto|contenido|resumen)
"""

WEAK = f"""
(this|our) {_PLACE}
(for|in|of) (the|this) (second|first|third|next|last|left|right|) (column|block|section|page|box|paragraph|part|layout|template)
(the|a|your|) (fatal error|warning|notice)
(until|till|before) the (real|final|actual|right) (text|content|copy|words) (arrives|comes|is ready|is written|follows)
(with|by) (the|your|a|an) (own words|own text|abstract|summary|introduction|description|content|text|results|title|caption)
(to|and) (continue|go on|proceed|reload|refresh)
then (reload|refresh|try again)
(to|before you can|before you|so that you can|if you want to|in order to) (view|see|use|display|read|open|load|show|run|access|browse) (the|this|our|these) {_PLACE}
in (your|this) {_CLIENT}
(for|on|of) this {_PLACE}
before (going live|you go live|publishing|publication|saving|you publish|you save)
that did not work
(before|) (opening|accessing|entering|showing|loading) (the|this) {_PLACE}
(it looks like|it seems that|it appears that|we are sorry but|please wait)
(please|) try again (later|in a few minutes|in a moment|in a few moments|shortly|soon) (or contact support|or contact the administrator|or write to support|)
(please|) try (reloading|again|refreshing|a different address|another address|a different page) (or contact (support|the administrator|us)|the page|)
(please|) (reload|refresh) (the page|) (or contact support|)
please (go|return) (back|) to the (start|home|front|main) page (or use the search (box|field|form)|)
if the problem (lasts|persists|continues|remains) (please|) (write to|contact|tell|inform) (the administrator|support|the webmaster|us)
(reference|request|ticket|incident|error|trace|correlation|event|session|ray) (number|id|code) 9
(reference|request|ticket|incident|error|trace|correlation|event|session|ray) (number|id|code) 9 9
(pod|node|worker|host|server|instance|region|zone) 9
(http|) status (code|) 9
this (takes|may take|will take) a few (seconds|moments|minutes)
(unfortunately|enabled|uh oh|oh no|oops|sorry|ooops|whoops|hoppla|entschuldigung|désolé|lo sentimos|perdón)
(home|start|help|login|contact|search|lines|markers|about)
bitte versuchen sie es (später|in einigen minuten|in kürze) (noch einmal|erneut|wieder)
bitte (kehren|gehen) sie zur startseite zurück (oder nutzen sie die suche|)
wenden sie sich an den administrator
(veuillez|) (réessayer|réessayez) (plus tard|dans quelques minutes)
(retournez|revenez) à la page d accueil (ou lancez une recherche|)
contactez l administrateur
(inténtelo|inténtalo|intente|pruebe) (de nuevo|otra vez|nuevamente) (más tarde|en unos minutos)
(vuelva|regrese) (al|a la) (inicio|página de inicio|página principal) (o use el buscador|)
(póngase en contacto|contacte) con el administrador
"""

#: Words of notices by the part they play, whatever the wording: what a notice is about, what it says of
#: it, and, where that is needed to tell it from a report, words that address the visitor. Phrases are parted by commas.
ROLES = {
    "scripts": (
        "javascript, js, java script, scripts, scripting, script, cookies, cookie, ad blocker, ad blockers, adblocker, adblock, skripte, skripten, scripte, les scripts, guiones",
        "enable, enabled, enabling, enables, activate, activating, permit, permitted, activated, allow, allowed, require, requires, required, need, needs, necessary, disabled, blocked, off, deactivated, support, supported, supports, turn on, turned on, "
        "turn it on, switch on, switched on, switch it on, accept, without, aktivieren, aktiviert, aktiviere, aktivierung, einzuschalten, eingeschaltet, zu aktivieren, verwendet, benötigen, unterstützt, einschalten, zulassen, erlauben, benötigt, erforderlich, erfordert, deaktiviert, blockiert, ausgeschaltet, ohne, voraussetzung, "
        "activer, activez, activé, activés, activée, activation, utilise, supporte, prend en charge, autoriser, autorisez, nécessite, nécessaire, nécessaires, requis, désactivé, désactivés, bloqué, sans, accepter, acceptez, "
        "activar, active, activa, activado, activados, habilitadas, habilitados, activadas, utiliza, usa, soporta, admite, precisa, habilitar, habilite, habilita, habilitado, permitir, permita, necesario, necesita, requiere, requerido, desactivado, deshabilitado, bloqueado, sin, acepte",
        "",
    ),
    "browser": (
        "browser, browsers, web browser, internet explorer, navigateur, navegador, browserversion",
        "not supported, not fully supported, no longer supported, no longer support, not support, older version, old version, latest version, switch to, use a, supported browser, supported browsers,  unsupported, outdated, out of date, too old, upgrade, update, not compatible, incompatible, newer, modern, obsolete, does not support, doesn t support, "
        "nicht unterstützt, aktuellen, aktuelle version, neuere, moderneren, modernen, aktualisieren sie, nicht mehr unterstützt, veraltet, aktualisieren, zu alt, pas compatible, plus compatible, récent, à jour, trop ancien, ancienne version, moderne, obsolète, pas pris en charge, plus pris en charge, mettre à jour, mettez à jour, no es compatible, no compatible, versión reciente, más reciente, antiguo, antigua, moderno, ya no es, obsoleto, desactualizado, actualice, actualiza, anticuado",
        "your, this, please, you, ihr, ihren, ihres, dieser, bitte, votre, ce, veuillez, su, tu, este, por favor",
    ),
    "visitor": (
        "human, robot, bot, captcha, real person, security verification, verification, challenge, suspicious activity, unusual activity, security check, humain, mensch, menschen, humano, roboter, visitors, connection is secure, secure connection, your browser, unusual traffic, automated requests, ddos protection, automated traffic",
        "verify, verifying, confirm, checking, check, prove, complete, solve, reviewing, review, verified, detected, protection, performing, just a moment, solving, passed, security, access, blocked, bestätigen, bestätige, überprüfen, überprüft, überprüfung, geprüft, prüfen, sicherheitsprüfung, vérifier, vérifiez, vérification, confirmer, confirmez, verificar, verifique, verifica, verificando, demuestre, demuestra, confirma, prouver, prouvez, confirmez que, confirme, compruebe, comprobando",
        "you, your, we, please, that you, before, sie, ihr, bitte, vous, votre, usted, eres, su, por favor, just a moment",
    ),
    "error": (
        "page, pages, limit, traffic, requests, location, url, link, document, file, resource, server, service, site, website, webpage, address, request, connection, gateway, access, permission, session, account, maintenance, downtime, proxy, portal, record, item, post, article, image, video, database, host, domain, host name, gateway, application, app, error, login, content, directory, "
        "seite, seiten, datei, dokument, dienst, server, service, wartung, wartungsarbeiten, konto, link, artikel, internetseite, homepage, portal, datenbank, anfrage, sitzung, zugriff, verbindung, adresse, fehler, inhalt, anwendung, webseite, website, anmeldung, zugang, "
        "lien, serveur, requête, connexion, accès, erreur, contenu, fichier, page web, ressource, compte, "
        "página, páginas, sitio, servidor, servicio, enlace, documento, archivo, dirección, solicitud, petición, conexión, acceso, sesión, contenido, aplicación, recurso, cuenta",
        "not found, not exist, doesn t exist, no longer exists, cannot be found, can t be found, can not be found, could not be found, couldn t be found, couldn t find, can t find, could not find, cannot find, unable to find, unavailable, "
        "not available, no longer available, isn t available, not accessible, expired, timed out, timed you out, denied, blocked, been blocked, forbidden, went wrong, gone wrong, has failed, overloaded, maintenance, been removed, been moved, was moved, was removed, been deleted, be broken, is broken, an error, unexpected error, refused, "
        "not authorized, unauthorized, not authorised, not allowed, not permitted, don t have permission, do not have permission, don t have access, do not have access, not have permission, log in, sign in, logged out, signed out, too many, try again, unable to, can t be reached, could not be reached, took too long, down for, is down, in error, rate limit, suspended, logged out, signed out, inactivity, locked, terminated, can t be displayed, could not be displayed, cannot be displayed, could not be loaded, cannot be loaded, failed to load, unable to load, not be loaded, not responding, not respond, too long to respond, refused to connect, refused the connection, limit exceeded, limit reached, exceeded, offline, down, be right back, be back, bad request, must be logged in, need to be logged in, need to log in, must log in, does not exist any more, not a valid, invalid, not valid, gone, crashed, malfunction, nothing was found, nothing here, encountered, interrupted, restricted, banned, been disabled, deleted, expired or, is missing, not working, isn t working, stopped working, not load, not open, "
        "nicht gefunden, existiert nicht, existiert leider, gibt es nicht, wartungsarbeiten, wartung, offline, nicht geladen, nicht angezeigt, nicht geöffnet, nicht laden, nicht anzeigen, nicht finden, nicht zugreifen, zugriff verweigert, ungültig, nicht zulässig, abgemeldet, eingeloggt sein, angemeldet sein, melden sie sich, zu viele, nicht beantwortet, antwortet nicht, überschritten, ein fehler, nicht existiert, leider nicht mehr, nicht mehr, nicht verfügbar, nicht erreichbar, abgelaufen, verweigert, gesperrt, keine berechtigung, nicht berechtigt, aufgetreten, überlastet, wartungsarbeiten, verschoben, gelöscht, entfernt, fehlgeschlagen, unterbrochen, anmelden, schiefgelaufen, ist ein fehler, "
        "n existe pas, n existe plus, n est plus, n est pas, hors ligne, en panne, pas pu être, impossible, inaccessible, invalide, connecté pour, identifier, déconnecté, trop de, ne répond pas, dépassé, une erreur, pas le droit, pas les droits, pas la permission, être connecté, introuvable, pas trouvé, pas trouvée, pas pu trouver, pas été trouvée, pas été trouvé, indisponible, expiré, expirée, refusé, refusée, interdit, produite, survenue, surchargé, déplacée, supprimée, maintenance, pas accès, pas autorisé, reconnecter, échoué, plus disponible, pas disponible, "
        "no existe, ya no, no encontrada, no hay, fuera de línea, fuera de servicio, no se pudo, no se puede, no pudo, no ha podido, imposible, inválido, inválida, inicie sesión, inicia sesión, demasiadas, demasiados, no responde, superado, un error, sin permiso, no está autorizado, no puede acceder, no tiene acceso, no tienes acceso, bloqueado, suspendida, cerrada, no encontrado, no se encuentra, no se encontró, no encontramos, no hemos encontrado, no se ha encontrado, no hemos podido encontrar, no pudimos encontrar, no está disponible, no disponible, caducado, expirado, denegado, prohibido, ocurrido, producido, sobrecargado, mantenimiento, movida, eliminada, no tiene permiso, no tienes permiso, fallado, iniciar sesión",
        "sorry, please, you, your, we, requested, currently, temporarily, this page, that page, this url, that url, this link, that link, this account, this content, this file, this resource, this document, this site, this website, this service, this request, that address, this address, this item, this session, the website, the page you, any page, encountered an, error has occurred, error occurred, our site, our servers, and try, nothing, looking for, oops, whoops, uh oh, try again, this server, that s, unfortunately, webmaster, administrator, apologize, apologise, apologies, our, "
        "leider, bitte, sie, ihre, ihr, ihren, ihrem, wir, unsere, unser, unserer, derzeit, momentan, zurzeit, vorübergehend, diese seite, dieser seite, dieses dokument, diese datei, dieser link, diese website, dieser dienst, ist ein fehler, fehler aufgetreten, gewünschte, angeforderte, gesuchte, aufgerufene, tut uns leid, hoppla, entschuldigung, ups, "
        "nous, vous, votre, notre, vos, actuellement, momentanément, temporairement, cette page, ce site, ce service, ce contenu, ce document, ce lien, ce fichier, une erreur,  désolé, désolés, veuillez, demandée, recherchée, demandé, oups, malheureusement, "
        "lo sentimos, usted, te, le, nuestro, nuestra, actualmente, temporalmente, esta página, este sitio, este servicio, este contenido, este enlace, este archivo, este documento, un error, error inesperado, disculpe, disculpa, tienes, tiene, su, tu, solicitada, solicitado, que buscas, que busca, que está buscando, por favor, inténtelo, inténtalo, perdón, vaya, ups",
    ),
    "filler": (
        "text, content, title, subtitle, heading, headline, paragraph, description, caption, copy, image, section, page, site, website, post, words, sample, placeholder, dummy, information, details, project, abstract, summary, layout, "
        "inhalt, inhalte, überschrift, absatz, beschreibung, seite, texte, contenu, titre, paragraphe, description, rubrique, texto, contenido, título, párrafo, descripción, página, sección",
        "goes here, go here, text here, content here, title here, description here, words here, here and here, name here, coming soon, coming shortly, to be announced, to be added, to be determined, to be confirmed, to follow, follow soon, will follow, add a, add some, enter a, write a, insert a, type a, put your, place your, paste your, describe your, add text, add title, add content, insert text, enter text, enter title, type here, write here, edit this text, change this text, remove this, delete this, add your, your own, click here, click to, tap to, double click, insert your, enter your, type your, write your, replace this, replace with, edit this, edit me, change this, "
        "under construction, check back, stay tuned, be added, be updated, be available soon, in progress, being updated, being written, sample page, sample text, sample content, dummy text, dummy content, placeholder text, placeholder content, first post, example text, is a placeholder, to be written, to be completed, "
        "folgt in kürze, folgen in kürze, folgt demnächst, folgt bald, folgt noch, entsteht, einzufügen, hinzuzufügen, zu bearbeiten, bearbeiten sie, ersetzen sie, ersetzen, geben sie, fügen sie, schreiben sie, klicken sie,  im aufbau, in arbeit, in bearbeitung, hier einfügen, hier eingeben, hier klicken, eigenen text, platzhalter, in vorbereitung, wird noch, beispieltext, überarbeitet, "
        "en construction, cours de construction, à compléter, à rédiger, ajouter, ajoutez, remplacez, remplacer, modifiez, modifier, écrivez, saisir, insérer, tapez, cliquez pour, sera bientôt, seront bientôt, à venir, bientôt, cliquez ici, votre texte, votre propre, en cours de rédaction, en cours de préparation, insérez, saisissez, texte d exemple, sera ajouté, sera ajoutée, sera disponible, "
        "en construcción, agregar, agregue, añadir, añada, añade, reemplace, reemplaza, sustituya, edite, edita, editar, escriba, escribe, introduzca, insertar, próximamente, más información, por completar, por definir, haga clic, haz clic, su texto, tu texto, su propio, en preparación, inserte, escriba aquí, escribe aquí, texto de ejemplo, texto de muestra, estará disponible, se añadirá",
        "your, here, soon, shortly, later, announced, placeholder, sample, dummy, edit or, add a, insert a, click, tap, check back, stay tuned, this is, this page, this section, this site, this text, this paragraph, edit me, under construction, will be, hier, ihr, ihren, ihre, deinen, dein, klicken, folgt, diese seite, dieser text, dieser bereich, kürze, demnächst, bald, im aufbau, "
        "ici, votre, vos, ton, cliquez, à venir, cette page, cette section, ce site, ce texte, bientôt, en construction, aquí, su, tu, haga clic, este sitio, esta sección, esta página, este texto, pronto, próximamente, en construcción",
    ),
}
#: Share of a sentence or line that such words and phrases must make up.
ROLE_COVERAGE = 0.9
_LEAST_WORDS = 3
#: Words that go with all of them.
NEUTRAL = (
    "a again all an and any are as at back be been because been before but by can cannot check clear closed come comes completely continue correctly could couldn currently days did didn display do does doesn doing don down due drawn each either ensure "
    "error experience features few find first fix follow following for found from fully function functions get getting go goes going good had has have having help hello home homepage hours how if in into is isn issue it its just know later latest "
    "let like load loaded loading longer look looking looks main make makes may me menu minute minutes moment moments more most must my navigate new no not now of offline ok on once one only open or order other our out page parts patience please "
    "portal previous problem problems proceed process properly refresh refreshing reload reloading render report requested resolve return run running s second seconds seem seems server settings shortly should show shown some something soon sorry start started still "
    "such support sure t team noscript rendered built shown plot map view viewer archive needs need quick only just which whether layout check again blank empty nothing location  temporarily temporary thank thanks that the their then there these they this those time to try trying turn typed unfortunately until up us use used user using version very view viewing visit visiting visitor wait want was way we "
    "web went were what when where which while will with won work working works world would you your yourself re ve ll d m via feature edit delete writing welcome wordpress web site website page application app technical difficulties "
    "minutes experiencing high traffic volume capacity limit exceeded reached exceeds bookmark mistyped spelling correct correctly search box contact support administrator webmaster owner code status http https id reference number ray ip address "
    "action action needed performance security protect malicious online attack attacks service services company automatically redirected redirect few complete completing below above button press hold proceed continuing access accessing perform available full functionality best "
    "9 systems system computer network device activity internet detected inactivity automated company sent sending again cannot able necessary settings turn turning using uses accept accepting needed full some advanced basic online secure own short long new real actual final any every encounters encountered occurred trouble while processing performing loading responding taking respond too cause caused reason reasons maybe perhaps might shall upgraded future past meantime inconvenience apologies apologise apologize regret trying tried attempt attempted attempting failed typing inline place post stay different blog because sidebar template theme example company name email password username form submit field fields required optional updated added coming shortly project title date author "
    "der die das den dem des ein eine einen einem einer und oder aber um zu zur zum in im am an auf für von mit ist sind wird werden wurde wurden kann können konnte konnten nicht mehr sie ihr ihre ihren ihrem ihres wir uns unsere unser es dass damit diese dieser dieses diesen "
    "bitte leider hier noch einmal erneut wieder später versuchen zurück startseite gehen nutzen verwenden benutzen anzeigen anzuzeigen angezeigt fortzufahren fortfahren darstellen dargestellt korrekt vollständig funktioniert laden geladen neu einstellungen browser "
    "administrator wenden suche moment kurz gerade vorübergehend möglicherweise oder eventuell falsch eingegeben gesuchte gewünschte angeforderte aufgerufene haben hat sein muss müssen als auch so nach bei aus wenn sich etwas dieser website nutzung wegen kürze neue neuer neues existiert gibt derzeit momentan zurzeit später erst über unter dabei ob noch wieder link links lesezeichen url prüfen überprüfen eingabe schreibweise befindet entsteht geht ging gelangen erhalten technischen gründen technische probleme störung entschuldigen unannehmlichkeiten verständnis danke vielen dank mensch roboter text klicken einen sowie um an den das als kontakt nehmen aufnehmen weiter klicken kontaktieren inhalte funktionen "
    "le la les l un une des du de d et ou mais pour par dans en sur à au aux est sont a ont été être avez avons n ne pas plus que qui vous votre nous notre ce cette cet ces il elle s se y si afin cela ici "
    "veuillez afficher voir consulter utiliser continuer réessayer réessayez plus tard retour retournez accueil page site navigateur ouvrir recharger actualiser fonctionner correctement pouvoir peut moment momentanément temporairement quelques minutes administrateur contactez recherche demandée recherchée "
    "erreur désolé désolés malheureusement adresse saisie peut être déplacée vérifiez paramètres cours votre vos mon mes tous toutes tout lien liens url existe existent trouvé trouver chargée charger trouve humain robot êtes pas merci patience désagrément excusez problème problèmes technique techniques raison raisons nouveau nouvelle encore bien sous fois ayant texte ajouter suite suivant suivante accéder accès fonctionnalités complète toutes les essayez tentez connectez connecter "
    "el los las un una unos unas de del al y o u pero para por en con sin que se su sus tu tus es son está están ha han sido ser hemos no más usted lo sentimos este esta esto estos estas aquí ver usar mostrar abrir continuar volver vuelva inicio intente inténtelo inténtalo tarde "
    "nuevo nuevamente momento minutos unos favor navegador página sitio web recargar recargue funcionar correctamente puede pueden podido solicitada solicitado buscas busca buscando administrador contacte búsqueda ajustes configuración necesitas necesita debe debes tiene tienes quiere quieres puedes acceder acceso enlace url dirección escrita mal gracias paciencia disculpe disculpa molestias problema problemas técnico técnicos nuestra nuestro nuestros error inesperado usar utilizar ha hemos vuelve vuelva volver iniciar sesión humano robot eres es ser texto contenido información pronto sección agregar clic haga haz funciones todas todo toda existe encontrar encontrado podemos pudimos ya otra vez"
)

#: Stems of pseudo-Latin filler (fixed values of the usual text).
PSEUDO_LATIN = frozenset(
    "lorem ipsum dolor dolore sit amet consec consectetur consectetuer adipis adipiscing adipisicing elit sed eiusmod tempor incididunt "
    "labo labore magna magni aliqua enim minim veniam quis nostrud nostra exercitation ullamco ullam laboris nisi aliquip commodo "
    "consequat duis aute irure reprehenderit voluptate velit velis esse cillum fugi fugiat nulla pariatur pari excepteur sint occa "
    "occaecat cupidatat proident sunt culpa officia deserunt mollit mollu anim est laborum tetura ferrum natus quidem vitae perspiciatis "
    "unde omnis iste error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae inventore veritatis".split()
) - {"error"}


#: A table whose lines stand for more phrases than this is a mistake.
MAX_PHRASES = 100_000


def expand(line: str) -> list[str]:
    """All phrases a line of the tables above stands for."""
    out = [""]
    depth, start, alternatives, i = 0, 0, [], 0
    while i < len(line):
        c = line[i]
        if c == "(":
            if depth == 0:
                out = [o + line[start:i] for o in out]
                start, alternatives = i + 1, []
            depth += 1
        elif c == "|" and depth == 1:
            alternatives += expand(line[start:i])
            start = i + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                alternatives += expand(line[start:i])
                out = [o + a for o in out for a in alternatives]
                start = i + 1
        i += 1
    return [" ".join((o + line[start:]).split()) for o in out]


@lru_cache(maxsize=1)
def phrases() -> dict[str, bool]:
    """Every phrase in plain words, with whether it is telling."""
    out: dict[str, bool] = {}
    for table, telling in ((WEAK, False), (SCRIPT_NOTICES, True), (ERROR_MESSAGES, True), (FILLERS, True)):
        for line in table.strip().splitlines():
            for p in expand(line):
                if p:
                    out[" ".join(words(p))] = telling
    if len(out) > MAX_PHRASES:
        raise ValueError(f"{len(out)} phrases")
    return out


#: Bits of the parts each kind of notice needs; three bits a kind.
_NEEDED = [sum(1 << 3 * k + j for j, words_of in enumerate(parts) if words_of) for k, parts in enumerate(ROLES.values())]
#: Neutral words, and the words role phrases are made of.
_PLAIN_WORDS = frozenset(["9"]) | {w for part in [NEUTRAL, *(t for tables in ROLES.values() for t in tables)] for w in words(part)}


@lru_cache(maxsize=1)
def _automaton():
    """Phrases and role words: (length, telling or None for a mere role word, its parts)."""
    import ahocorasick

    parts: dict[str, int] = {}
    for k, tables in enumerate(ROLES.values()):
        for j, table in enumerate(tables):
            for p in table.split(","):
                if p.strip():
                    name = " ".join(words(p))
                    parts[name] = parts.get(name, 0) | 1 << 3 * k + j
    known = phrases()
    a = ahocorasick.Automaton()
    for p in known.keys() | parts.keys():
        a.add_word(f" {p} ", (len(p.split(" ")), known.get(p), parts.get(p, 0)))
    a.make_automaton()
    return a


def _notice(seen: int) -> bool:
    return any(seen & need == need for need in _NEEDED)


_LATIN = frozenset(" ".join(words(w)) for w in PSEUDO_LATIN)
_SENTENCE_END = re.compile(r"(?<=[.!?:;…|])[\"'”»)]*\s+|\s*\n\s*\n\s*|\n(?=[ \t]*(?:[-*•#>]|\d+[.)]\s|\d\d:\d\d))")
_LINE_END = re.compile(r"\s*\n\s*")
#: Addresses and paths, which a message may name.
_ADDRESS = re.compile(r"(?:https?://|www\.|(?<!\S)/)[\w./?=&%~#:-]*\w/?")
_LEAD = re.compile(r"^(?:[\s*•#>-]+|\d+[.)]\s+|\d\d:\d\d(?::\d\d)?\s+|(?:INFO|WARN|ERROR|DEBUG)\s+)+")
_LEAST_LATIN = 4
#: A line within a sentence may be a piece of quoted text, so more of it must be covered.
_LINE_COVERAGE = 0.85


def _tokens(text: str) -> list[str]:
    return ["9" if w.isdigit() else w for w in words(text)]


def coverage(tokens: list[str], roles: bool = True) -> tuple[float, bool]:
    """Share of the words that lie in phrases, and whether a telling one is among them.

    A notice by its roles (where ``roles`` are to be looked at) has the share of its role and neutral words.
    """
    if not tokens:
        return 0.0, False
    line = f" {' '.join(tokens)} "
    covered, played = bytearray(len(tokens)), bytearray(len(tokens))
    telling, seen = False, 0
    upto, before = 0, 0
    for end, (n, strong, parts) in _automaton().iter(line):
        before += line.count(" ", upto, end)
        upto = end
        if strong is not None:
            covered[before - n : before] = b"\1" * n
            telling |= strong
        if parts:
            played[before - n : before] = b"\1" * n
            seen |= parts
    share = sum(covered) / len(tokens)
    latin = sum(w in _LATIN for w in tokens)
    if latin >= _LEAST_LATIN:
        return max(share, latin / len(tokens)), True
    if roles and len(tokens) >= _LEAST_WORDS and _notice(seen):
        known = sum(c or p or w in _PLAIN_WORDS for c, p, w in zip(covered, played, tokens)) / len(tokens)
        if known >= ROLE_COVERAGE:
            return max(share, known), True
    return share, telling


_PARAGRAPH_END = re.compile(r"\s*\n[^\S\n]*\n\s*")


def _segments(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Sentences, the lines within them that may stand alone (True), and paragraphs of several sentences; last, whether it is complete."""
    for paragraph in _PARAGRAPH_END.split(text):
        parts = [p for p in _SENTENCE_END.split(paragraph) if p and not p.isspace()]
        for part in parts:
            yield part, False, True
            lines = [x for x in _LINE_END.split(part) if x]
            if len(lines) > 1:
                # a line that starts in lower case goes on from the one before
                goes_on = [not x[0].isupper() for x in lines] + [False]
                yield from ((x, True, not goes_on[i + 1]) for i, x in enumerate(lines) if i == 0 or not x[0].islower())
                # a message may follow a title line
                if not lines[1][0].islower():
                    yield " ".join(lines[1:]), True, True
        if len(parts) > 1:
            yield paragraph, True, True


# --------------------------------------------------------------- placeholders

_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*"


def _upto(delimiters: str) -> str:
    """Text of any length without these delimiters and without a paragraph break."""
    return rf"[^{delimiters}\n]*+(?:\n(?![^\S\n]*\n)[^{delimiters}\n]*+)*"


_BRACES, _ANGLES, _SQUARES = _upto("{}"), _upto("<>"), _upto(r"\[\]")
#: Delimiters that mark a field beyond doubt, with any name or none in them. A field ends at its own closing delimiter, at most at the paragraph's end.
_SURE = re.compile(
    r"\{\{\{?" + _BRACES + r"\}?\}\}"
    r"|\\\{\\?\{" + _BRACES + r"(?<=\\)\}\\?\}"
    r"|[$#]\{" + _BRACES + r"\}"
    r"|<%[=-]?" + _upto("%<>") + r"%>|\{%" + _upto("%{}") + r"%\}|<\?php\b" + _ANGLES + r"(?<=\?)>|<\?=" + _ANGLES + r"(?<=\?)>"
    r"|@@\s?" + _ID + r"\s?@@|<<\s?" + _ID + r"\s?>>|\[\[\s?" + _ID + r"\s?\]\]"
    r"|<\s?(?:insert|enter|your|add|put|name of|type)\b" + _ANGLES + r">"
    r"|\((?:fill in|insert|enter|to be filled in)\b" + _upto("()") + r"\)"
    r"|\[\s?(?:TODO|TBD|FIXME|TBA)\s?:" + _SQUARES + r"\]"
    r"|\[\s?(?:insert|enter|your|add|put|type|write|fill in|name of|description of|replace)\b" + _SQUARES + r"\]"
    r"|\[\s?(?:hier\b|escriba|inserte|introduzca|indique|insérer|insérez|saisir|saisissez|indiquer|écrire|einfügen|eintragen|bitte\b)(?:" + _SQUARES + r"\])?"
    r"|\[" + _SQUARES + r"(?:(?<=eintragen)|(?<=einfügen)|(?<=einsetzen)|(?<=eintragen\s)|(?<=einfügen\s)|(?<=einsetzen\s))\]"
    r"|<!--\s*(?:begin|end|insert|todo|placeholder)\b" + _ANGLES + r"(?<=--)>"
    r"|%\(" + _ID + r"\)[sdf]"
    r"|(?<![\w.:])i18n:[\w.]+"
    r"|\[object Object\]|&lt;\s?" + _ID + r"\s?&gt;|%7B%7B[\w.]+%7D%7D",
    re.IGNORECASE,
)
#: A name between delimiters that also have other uses.
_NAMED = re.compile(
    r"(?<![<\w])<(?P<a>" + _ID + r")>(?!>)|(?<![\[\w])\[(?P<b>" + _ID + r"|(?:[A-Z][a-z]+ )+[A-Z][a-z]+)\](?![\](])"
    r"|(?<![{$#%\w\\])\{(?P<c>" + _ID + r"|[0-9]?(?::[^{}\s]{1,8})?)\}(?!\})"
    r"|(?<![\w%])%(?P<d>" + _ID + r")%(?!\w)|(?<![\w$])\$(?P<e>" + _ID + r")\$(?!\w)"
    r"|(?<![\w_])__(?P<f>" + _ID + r")__(?![\w_])"
    r"|(?<![\w%])%(?P<g>[sd])(?![\w%])"
)
#: Output of a failed web application, which has no other reason to be in a text.
_TRACE = re.compile(r"\bat\s+[\w.$]+\(\s*\w+\.java:\d+\)|\bin\s+\S+\.(?:php|inc)\s+on\s+line\s+\d+|\bcall\s+to\s+undefined\s+(?:function|method)\b", re.IGNORECASE)
_BLANKS_TO_FILL = re.compile(r"(?<![\w_])_{4,}(?![\w_])|(?<!\w)X{4,}(?!\w)|\bXX (?:degrees|days|plants|lines|percent|hours|cm|mm)\b|(?<![\w.])\.{6,}(?![\w.])")
_PERCENT = re.compile(r"%[A-Za-z]")
_RULE_LINE = re.compile(r"^[\s_=*.-]+$")
_CODE = re.compile(r"```.*?```|`[^`\n]*\n?[^`\n]*`", re.DOTALL)
_QUOTED = re.compile(r"(?<!\w)'(?:[^'\n]|(?<=\w)'(?=\w))*+'(?!\w)|\"[^\"\n]*+\"|“[^”\n]*+”|„[^“”\n]*+[“”]|«[^»\n]*+»")
_EXPLAINS = re.compile(
    r"\bstands? for\b|\bprints? the\b|\breplaces\b|\b(?:template|query|markup) language\b|\bin the manual\b|\btags? in\b|\bplaceholders?\b"
    r"|\bsteht für\b|\bstehen für\b|\bplatzhalter\b|\bremplace\b|\bsignifie\b|\bdésigne\b|\bsignifica\b|\breemplaza\b|\brepresenta\b",
    re.IGNORECASE,
)
#: Names between these delimiters that are markup, remarks or names of a language, not fields (fixed values).
_MARKUP = frozenset("a b i u p br hr em strong sub sup code pre ul ol li td tr th table div span img html head body h1 h2 h3 h4 script style link meta".split())
_REMARKS = frozenset("sic see cf ibid ed eds note todo tbd i b u code img url quote file all".split())
_LANGUAGE = frozenset("init main name file all doc str repr len call enter exit iter next eq hash dict class".split())
_NOT_FIELDS = {"a": _MARKUP, "b": _REMARKS, "c": frozenset(), "d": frozenset(), "e": frozenset(), "f": _LANGUAGE, "g": frozenset()}
_START, _END = re.compile(r"(?:^|[.!?]\s+|\n\s*\n|\n(?=[-*•#]))"), re.compile(r"[.!?](?:\s|$)|\n\s*\n|\n(?=[-*•#])|$")


def _sentence(text: str, starts: list[int], at: int, end: int) -> str:
    """The sentence around a stretch; starts: where sentences begin, in order."""
    k = bisect_right(starts, at)
    m = _END.search(text, end)
    return text[starts[k - 1] if k else 0 : m.start() if m else len(text)]


def _possible(text: str) -> list[re.Pattern]:
    """The patterns whose delimiters occur in a text at all."""
    low = text.lower()
    common = "{" in text or "<" in text or "[" in text
    out = []
    if common or any(x in low for x in ("@@", "%(", "%7b", "i18n:", "&lt;", "(fill in", "(insert", "(enter", "(to be filled")):
        out.append(_SURE)
    if common or "$" in text or "__" in text or _PERCENT.search(text):
        out.append(_NAMED)
    if "____" in text or "XX" in text or "......" in text:
        out.append(_BLANKS_TO_FILL)
    return out


#: A field up to this long, and on one line, leaves quotations and code around it as they are matched.
_SHORT = 60


def _around(text: str, a: int, b: int, kinds: tuple[re.Pattern, ...]) -> bool:
    """Whether quotations or code hold a long field, whose own length and lines don't count."""
    cut = text[: a + 1] + text[b - 1 :]
    return any(q.start() < a and a + 2 < q.end() for k in kinds for q in k.finditer(cut))


def placeholder(text: str) -> str | None:
    """The first unfilled field of a text."""
    kinds = _possible(text)
    if not kinds:
        return None
    hidden = [m.span() for m in _CODE.finditer(text)] if "`" in text else []
    quoted: list[tuple[int, int]] | None = None
    starts: list[int] | None = None
    for kind in kinds:
        for m in kind.finditer(text):
            a, b = m.span()
            if any(x <= a and b <= y for x, y in hidden):
                continue
            if kind is _NAMED:
                name = next(g for g in m.groups() if g is not None) if m.lastgroup else ""
                if name.lower() in _NOT_FIELDS[m.lastgroup or "c"] or len(name) == 1 and name.isalpha() and m.lastgroup != "g":
                    continue
                if m.lastgroup in ("b", "e") and len(name) < 3 or m.lastgroup == "e" and name.islower() and len(name) < 4:
                    continue
            if kind is _BLANKS_TO_FILL:
                line = text[text.rfind("\n", 0, a) + 1 : (text.find("\n", b) + 1 or len(text) + 1) - 1]
                if _RULE_LINE.match(line):
                    continue
            if kind is _SURE and (b - a > _SHORT or "\n" in m.group(0)) and _around(text, a, b, (_CODE, _QUOTED)):
                continue
            if quoted is None:
                quoted = [q.span() for q in _QUOTED.finditer(text)]
            if any(x < a and b < y for x, y in quoted):
                continue
            if starts is None:
                starts = [q.end() for q in _START.finditer(text)]
            if _EXPLAINS.search(_sentence(text, starts, a, b)):
                continue
            return m.group(0)
    return None


def residue(text: str | None, min_coverage: float = 0.6) -> tuple[str, str] | None:
    """(kind, what was found) if a text holds residue: placeholder or message."""
    if not text:
        return None
    found = placeholder(text)
    if found:
        return "placeholder", found
    low = text.lower()
    trace = _TRACE.search(text) if ".java:" in low or "line" in low and (".php" in low or ".inc" in low) or "undefined" in low else None
    if trace and not any(q.start() < trace.start() and trace.end() < q.end() for k in (_CODE, _QUOTED) for q in k.finditer(text)):
        return "message", trace.group(0)
    tokens = _tokens(text)
    if not tokens:
        return None
    line = f" {' '.join(tokens)} "
    seen = 0
    for _, (_, strong, parts) in _automaton().iter(line):
        seen |= parts
        if strong or _notice(seen):
            break
    else:
        if sum(w in _LATIN for w in tokens) < _LEAST_LATIN:
            return None
    for part, alone, complete in _segments(text):
        share, telling = coverage(_tokens(_ADDRESS.sub(" ", _LEAD.sub("", part))), complete)
        if telling and share >= (max(min_coverage, _LINE_COVERAGE) if alone else min_coverage):
            return "message", part.strip()
    return None


def find_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_coverage: float = 0.6) -> DataFrame:
    """doc_id, kind, found of every document with residue; a map over whole texts without a shuffle."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hit = residue(t, min_coverage)
                if hit:
                    rows.append((d, *hit))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "kind", "found"])

    return docs.mapInArrow(run, "doc_id long, kind string, found string")


def without_residue(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no residue."""
    bad = found.select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, documents[doc_id] == F.col("_bad"), "left_anti")
