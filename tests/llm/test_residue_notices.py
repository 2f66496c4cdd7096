"""Recall and precision on everyday notices that aren't taken from the test tables.

The notices were written down from well-known public pages, after the first role
tables and before any tuning on them. Only misses of the even ones were read while
tuning; the odd ones must reach the same bounds.
"""

import pytest

from locusloom.llm.residue import residue

NOTICES = """
You need to enable JavaScript to run this app.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Verify you are human by completing the action below.
Please turn JavaScript on and reload the page.
404. That's an error. The requested URL /x was not found on this server. That's all we know.
Sorry, you have been blocked.
This site requires JavaScript to be enabled in your browser settings.
Our website uses cookies. Please enable cookies in your browser and try again.
Checking your browser before accessing example.org. This process is automatic.
This process is automatic. Your browser will redirect to your requested content shortly. Please allow up to 5 seconds.
Your browser does not support JavaScript!
Please complete the security check to access this website.
Internet Explorer is no longer supported. Please upgrade to a modern browser.
You are using an outdated browser. Please upgrade your browser to improve your experience.
For full functionality of this site it is necessary to enable JavaScript.
Please enable Cookies and reload the page.
It seems JavaScript is either disabled or not supported by your browser.
Just a moment...
Performance & security by Cloudflare
Please confirm that you are not a robot.
Our systems have detected unusual traffic from your computer network.
JavaScript must be enabled in order for you to use this site.
Oops! That page can't be found.
It looks like nothing was found at this location.
The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.
This page isn't working right now. HTTP ERROR 500
The requested resource could not be found but may be available again in the future.
Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.
We can't find the page you're looking for.
500 Internal Server Error. The server encountered an internal error or misconfiguration and was unable to complete your request.
Sorry, something went wrong. We're working on it and we'll get it fixed as soon as we can.
Service Temporarily Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
You don't have permission to access this resource.
Access to this page has been denied.
Your session has timed out. Please log in again.
You must be logged in to view this page.
You have been logged out due to inactivity.
The connection has timed out. The server at example.org is taking too long to respond.
This site can't be reached. The server refused to connect.
Rate limit exceeded. Please try again in a few minutes.
We are currently down for maintenance. We will be back shortly.
Briefly unavailable for scheduled maintenance. Check back in a minute.
The website is currently unavailable. Please try again later.
Whoops, looks like something went wrong.
A database error has occurred. Please contact the administrator.
429 Too Many Requests
This account has been suspended.
Unfortunately, the page you requested could not be displayed.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.
This is a sample page. It's different from a blog post because it will stay in one place.
Welcome to WordPress. This is your first post. Edit or delete it, then start writing!
Click here to add your own text and edit me.
I'm a paragraph. Click here to add your own text.
Your content goes here. Edit or remove this text inline.
Insert your text here.
This page is under construction. Please check back soon.
Coming soon! Stay tuned.
This section will be updated soon.
Placeholder text. Replace with your own content.
Add a short description of your project here.
Details to be announced.
Content coming shortly.
[Insert company name here]
Dear [Name], thank you for your order.
Dear {{first_name}}, your account is ready.
Hello %FIRSTNAME%, welcome back.
Published on [DATE] by [AUTHOR].
© {year} All rights reserved.
Sehr geehrte(r) [Nachname], wir danken für Ihre Bestellung.
Title: ${title}
Diese Seite existiert leider nicht mehr.
Die angeforderte Seite konnte nicht gefunden werden.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um fortzufahren.
Für die Nutzung dieser Website muss JavaScript aktiviert sein.
Ihr Browser ist veraltet. Bitte aktualisieren Sie ihn.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.
Der Zugriff auf diese Seite wurde verweigert.
Wegen Wartungsarbeiten ist unsere Website vorübergehend nicht erreichbar.
Bestätigen Sie, dass Sie ein Mensch sind.
Hier entsteht in Kürze eine neue Internetpräsenz.
Diese Seite befindet sich im Aufbau.
Hier klicken, um Text einzufügen.
Inhalt folgt in Kürze.
Nous n'avons pas trouvé la page que vous recherchez.
Désolé, cette page n'existe plus.
Veuillez activer JavaScript dans votre navigateur pour continuer.
JavaScript est désactivé dans votre navigateur.
Votre session a expiré, veuillez vous reconnecter.
Une erreur est survenue, veuillez réessayer plus tard.
Vous n'avez pas accès à cette page.
Vérifiez que vous êtes humain.
Cette page est en cours de construction.
Cliquez ici pour ajouter votre texte.
Contenu à venir.
Lo sentimos, la página que buscas no existe.
No hemos podido encontrar la página solicitada.
Por favor, active JavaScript en su navegador para continuar.
Necesitas habilitar JavaScript para usar esta aplicación.
Su sesión ha expirado. Vuelva a iniciar sesión.
Ha ocurrido un error inesperado. Inténtelo de nuevo más tarde.
No tienes permiso para acceder a esta página.
Verifique que usted es humano.
Este sitio está en construcción.
Haga clic aquí para agregar su texto.
Próximamente más información.
""".strip().splitlines()

PLAIN = """
JavaScript was the language of choice for the plotting module, and its tests run in the browser.
We enabled JavaScript in the kiosk browser and counted 14 visitors.
The page was not found in the herbarium binder, so we searched the shelf.
Cookies were baked for the open day at the station.
The server room was closed for maintenance while we scored the plants.
A 404 page is what a web server shows when a page is missing.
Error 500 appeared twice last week; the admin restarted the service each time.
The session on drought tolerance has been moved to room 4.
Access to the greenhouse was denied because the sprayer was running.
Our browser study compared roe deer and hare as browsers of young shoots.
The captcha on the upload form annoyed three users.
We could not find the marker in the second panel.
The connection between flowering time and latitude was weak.
The link between kinship and trait was removed by the model.
Please log in to the cluster with your own account before you start the scan.
Please enter the plot number and the date on every bag.
The text of the label was replaced after the second season.
Add 20 ml of buffer, then close the tube and wait a minute.
The new section on soil will be added to the manual next year.
The site at Lund is under snow until April.
The path under construction east of the field cut off two plots.
The description of the allele goes back to 1998.
Her talk title was "Page not found", and it was about lost notebooks.
The manual says: 'Please enable JavaScript to view this page.' We ignored it.
The placeholder {{title}} stands for the title of the report.
In the template language, [name] stands for the recipient.
Use %s for text and %d for numbers in the format string `%s: %d`.
The array x[i] holds the counts, and f(x) = {x | x > 0} is the support.
He wrote $5 and $10 on the two bags.
Confidence [0.2, 0.4] and <5 % missing calls were accepted.
Two visitors asked whether robots or humans had sown the rows.
The security check at the airport destroyed one seed packet.
Traffic near the plot was unusual during the harvest festival.
The service life of the lamp is 2,000 hours.
The requested seeds were not available, so we ordered other lines.
Your samples arrived and we are sorry that two tubes were broken.
Sorry, I lost the list; could you send it again?
Unfortunately the pump failed and the trays dried out.
We are working on the second paper and will share the draft soon.
More information about the lines is given in the supplement.
Die Seite im Feldbuch wurde nicht gefunden, also zählten wir neu.
Bitte tragen Sie die Nummer des Topfes und das Datum ein.
Der Zugang zum Gewächshaus war wegen Bauarbeiten gesperrt.
Die Sitzung der Arbeitsgruppe ist auf Montag verschoben.
Die Skripte zur Auswertung liegen im Ordner der Gruppe.
Le serveur de calcul a été arrêté pendant la récolte.
La page de garde du cahier a été arrachée par le vent.
Le contenu des sachets a été pesé avant le semis.
La sesión de tarde trató del riego y de las heladas.
El servidor de la estación guarda los datos de cada parcela.
El texto de la etiqueta se borró con la lluvia.
Kinship was estimated from 1,204 markers, and the scan was run again without the outliers.
The browser shows the peak on chromosome 4; zoom in to see the two genes.
A human observer and the camera agreed in 93 of 100 pots.
The error of the mean is shown for each site and year.
The script needs the kinship matrix and the list of lines.
The application was refused by the fund, and we applied again in May.
The data are available from the archive under the number of the study.
The image of the silique was taken at noon.
The next page lists the lines that were lost.
""".strip().splitlines()


def figures(notices, plain):
    found = [bool(residue(x)) for x in notices]
    wrong = [x for x in plain if residue(x)]
    recall = sum(found) / len(found)
    return recall, sum(found) / (sum(found) + len(wrong))


@pytest.mark.parametrize("start", [0, 1], ids=["tuned", "held_out"])
def test_recall_and_precision(start):
    recall, precision = figures(NOTICES[start::2], PLAIN[start::2])
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


@pytest.mark.parametrize("start", [0, 1], ids=["tuned", "held_out"])
def test_notices_within_content(start):
    real = "The lead marker explains 12.5% of the variance, and its minor allele is carried by 17 lines."
    recall, _ = figures([f"{real}\n\n{x}\n\n{real}" for x in NOTICES[start::2]], [])
    assert recall >= 0.9
    assert not any(residue(f"{real} {x} {real}") for x in PLAIN[start::2] if not residue(x))
