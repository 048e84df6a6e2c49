"""Labelled prose from which the language dictionaries are built: plain sentences of the kind found in comments and messages of programs that deal with data."""

SEED = {
    "en": """The function returns the value of the first column and raises an error when the input is empty. This is not the place where we should change the order of the rows, because other parts of the program depend on it. If there is nothing to do, the caller gets an empty list. We have to check that the file exists before it is opened, otherwise the message would be confusing. Please make sure that both arguments have the same length. It would be better to keep the old behaviour until all users have moved to the new version. Only the last element is used here, and it must be larger than zero. Every time the model is fitted, the previous results are thrown away. Warning: this may take several minutes with many observations. The user should never see this text. What happens when two threads write at the same time? They wait for each other, so no data can be lost. Do not remove these lines, they are needed for the tests. After the loop has ended we know how many values were missing. A missing number is replaced by the mean of its group, which was computed above. Could not open the connection, try again later. There are too many parameters for so few points. Some of them might be wrong but that does not matter now. Use this only if you know what you are doing. Nothing was found with that name. Each item must appear at least once before we can go on. See also the notes at the end of this file for more about the method and its limits. How long should it run? Until the difference between one step and the next is small enough. The matrix cannot be inverted since its columns are not independent. I think we could write this more simply, however it works and is fast.
We estimate the variance of the sample from squared residuals and divide it by the degrees of freedom. The weights of all rows must add up to one, and a weight below zero is not allowed. Sort the table by firm and year first, since lags and differences are taken within each firm. The constant is dropped because the regressors were centred and scaled beforehand. When the panel is short the estimator is biased, so an instrument built from older lags is used instead. A slope close to zero tells us little about the sign of the effect. Standard errors are grouped by cohort and robust against outliers. It took a long time to find out why the curve was so rough; the kernel and its bandwidth had been chosen badly. The penalty keeps the coefficients small, but it also moves them away from the truth. Nobody knows whether this branch can still be reached, so leave it as it was. Later versions reuse the vector that we store here. This path is slower yet exact, and it gives the same answer as the formula in the paper. Remember to close the file and to free the memory once the last block was read. The name of a variable may hold blanks, which is why it has to be quoted. Too little is known about the starting values, thus we try several and keep the best of them. The series has a unit root and must be differenced; otherwise the test would reject far too often. Too few points are left in this window to compute a reliable number. If the search fails we fall back to the simple rule and tell the reader why. Our thanks go to those who reported the wrong sign. You cannot mix both kinds of dates, even though they look alike. These figures were checked by hand against tables from a printed book. Rows with a missing answer are skipped while the others are counted twice. Its level, trend and season are updated at every step. Please choose a number between one and ten, then press enter to go on with the next question. This should have been fixed already; it still breaks whenever the list is not sorted or empty. Let us hope that no one ever calls it with negative counts. The score of each unit, the length of its record and the day of entry are kept in one place. An even simpler way exists, though it needs more memory than most machines have.""",
    "pt": """A função devolve o valor da primeira coluna e gera um erro quando a entrada está vazia. Este não é o lugar onde devemos mudar a ordem das linhas, porque outras partes do programa dependem dela. Se não houver nada para fazer, quem chama recebe uma lista vazia. Temos de verificar se o arquivo existe antes de ser aberto, caso contrário a mensagem seria confusa. Por favor, confira se os dois argumentos têm o mesmo tamanho. Seria melhor manter o comportamento antigo até que todos os usuários passem para a nova versão. Apenas o último elemento é usado aqui, e ele deve ser maior do que zero. Cada vez que o modelo é ajustado, os resultados anteriores são jogados fora. Atenção: isto pode levar vários minutos com muitas observações. O usuário nunca deveria ver este texto. O que acontece quando duas tarefas escrevem ao mesmo tempo? Elas esperam uma pela outra, então nenhum dado pode ser perdido. Não remova estas linhas, elas são necessárias para os testes. Depois que o laço termina sabemos quantos valores estavam em falta. Um número ausente é substituído pela média do seu grupo, que foi calculada acima. Não foi possível abrir a conexão, tente de novo mais tarde. Há parâmetros demais para tão poucos pontos. Alguns deles podem estar errados, mas isso não importa agora. Use isto somente se você souber o que está fazendo. Nada foi encontrado com esse nome. Cada item deve aparecer pelo menos uma vez antes de podermos continuar. Veja também as notas no fim deste arquivo para saber mais sobre o método e os seus limites. Quanto tempo deve rodar? Até que a diferença entre um passo e o próximo seja pequena o bastante. A matriz não pode ser invertida já que as suas colunas não são independentes. Acho que poderíamos escrever isto de modo mais simples, porém funciona e é rápido.
Estimamos a variância da amostra a partir dos resíduos ao quadrado e dividimos pelos graus de liberdade. Os pesos de todas as linhas devem somar um, e não é permitido um peso abaixo de zero. Ordene primeiro a tabela por empresa e ano, pois as defasagens e as diferenças são tomadas dentro de cada empresa. A constante é retirada porque os regressores já foram centrados e postos em escala. Quando o painel é curto o estimador fica enviesado, por isso usa-se em seu lugar um instrumento feito com defasagens mais antigas. Uma inclinação perto de zero diz pouco sobre o sinal do efeito. Os erros padrão são agrupados por coorte e robustos a valores extremos. Levou muito tempo para descobrir por que a curva era tão irregular; o núcleo e a sua largura de banda tinham sido mal escolhidos. A penalização mantém os coeficientes pequenos, mas também os afasta da verdade. Ninguém sabe se este ramo ainda pode ser alcançado, então deixe como estava. As versões seguintes reaproveitam o vetor que guardamos aqui. Este caminho é mais lento, porém exato, e dá a mesma resposta que a fórmula do artigo. Lembre de fechar o arquivo e de liberar a memória assim que o último bloco for lido. O nome de uma variável pode conter espaços, e é por isso que tem de vir entre aspas. Sabe-se muito pouco sobre os valores iniciais, logo tentamos vários e ficamos com o melhor deles. A série tem raiz unitária e precisa ser diferenciada; senão o teste rejeitaria vezes demais. Sobram poucos pontos nesta janela para calcular um número confiável. Se a busca falhar voltamos à regra simples e explicamos ao leitor o motivo. Agradecemos a quem avisou do sinal trocado. Você não pode misturar os dois tipos de data, embora sejam parecidos. Estes números foram conferidos à mão com as tabelas de um livro impresso. As linhas sem resposta são puladas enquanto as outras contam duas vezes. O nível, a tendência e a estação são atualizados a cada passo. Escolha um número entre um e dez, depois pressione a tecla para continuar com a pergunta seguinte. Isto já deveria ter sido corrigido; ainda quebra sempre que a lista não está ordenada ou está vazia. Esperamos que nunca alguém chame isto com contagens negativas. A pontuação de cada unidade, o comprimento do seu registro e o dia de entrada ficam num só lugar. Existe uma maneira ainda mais simples, mas precisa de mais memória do que a maioria das máquinas tem. Falta verificar também o que acontece quando não há dados, pois o resultado muda muito.""",
    "es": """La función devuelve el valor de la primera columna y lanza un error cuando la entrada está vacía. Este no es el lugar donde debemos cambiar el orden de las filas, porque otras partes del programa dependen de él. Si no hay nada que hacer, quien llama recibe una lista vacía. Tenemos que comprobar que el archivo existe antes de abrirlo, de lo contrario el mensaje sería confuso. Por favor, asegúrese de que los dos argumentos tengan la misma longitud. Sería mejor mantener el comportamiento antiguo hasta que todos los usuarios pasen a la nueva versión. Solo el último elemento se usa aquí, y debe ser mayor que cero. Cada vez que se ajusta el modelo, los resultados anteriores se desechan. Cuidado: esto puede tardar varios minutos con muchas observaciones. El usuario nunca debería ver este texto. ¿Qué pasa cuando dos hilos escriben al mismo tiempo? Se esperan el uno al otro, así que ningún dato se puede perder. No quite estas líneas, son necesarias para las pruebas. Después de que termina el bucle sabemos cuántos valores faltaban. Un número ausente se sustituye por la media de su grupo, que fue calculada arriba. No se pudo abrir la conexión, inténtelo de nuevo más tarde. Hay demasiados parámetros para tan pocos puntos. Algunos de ellos pueden estar equivocados, pero eso no importa ahora. Utilice esto solo si sabe lo que está haciendo. No se encontró nada con ese nombre. Cada elemento debe aparecer al menos una vez antes de que podamos seguir. Vea también las notas al final de este archivo para saber más sobre el método y sus límites. ¿Cuánto tiempo debe correr? Hasta que la diferencia entre un paso y el siguiente sea lo bastante pequeña. La matriz no se puede invertir ya que sus columnas no son independientes. Creo que podríamos escribir esto de manera más sencilla, sin embargo funciona y es rápido.
Estimamos la varianza de la muestra a partir de los residuos al cuadrado y la dividimos por los grados de libertad. Los pesos de todas las filas deben sumar uno, y no se permite un peso por debajo de cero. Ordene primero la tabla por empresa y año, pues los rezagos y las diferencias se toman dentro de cada empresa. La constante se quita porque los regresores ya fueron centrados y puestos en escala. Cuando el panel es corto el estimador queda sesgado, por eso se usa en su lugar un instrumento hecho con rezagos más antiguos. Una pendiente cerca de cero dice poco sobre el signo del efecto. Los errores estándar se agrupan por cohorte y son robustos frente a valores extremos. Costó mucho tiempo descubrir por qué la curva era tan irregular; el núcleo y su ancho de banda habían sido mal elegidos. La penalización mantiene pequeños los coeficientes, pero también los aleja de la verdad. Nadie sabe si todavía se puede llegar a esta rama, así que déjela como estaba. Las versiones siguientes reutilizan el vector que guardamos aquí. Este camino es más lento pero exacto, y da la misma respuesta que la fórmula del artículo. Recuerde cerrar el archivo y liberar la memoria en cuanto se haya leído el último bloque. El nombre de una variable puede contener espacios, y por eso tiene que ir entre comillas. Se sabe muy poco sobre los valores iniciales, luego probamos varios y nos quedamos con el mejor de ellos. La serie tiene raíz unitaria y hay que diferenciarla; si no, la prueba rechazaría demasiadas veces. Quedan pocos puntos en esta ventana para calcular un número fiable. Si la búsqueda falla volvemos a la regla sencilla y le explicamos al lector el motivo. Damos las gracias a quienes avisaron del signo cambiado. Usted no puede mezclar los dos tipos de fecha, aunque se parezcan. Estos números fueron revisados a mano con las tablas de un libro impreso. Las filas sin respuesta se saltan mientras las otras cuentan dos veces. El nivel, la tendencia y la estación se actualizan en cada paso. Elija un número entre uno y diez, después pulse la tecla para continuar con la pregunta siguiente. Esto ya debería haberse corregido; todavía se rompe siempre que la lista no está ordenada o está vacía. Ojalá nunca alguien llame a esto con recuentos negativos. La puntuación de cada unidad, la longitud de su registro y el día de entrada se guardan en un solo lugar. Existe una manera aún más sencilla, aunque necesita más memoria de la que tiene la mayoría de las máquinas. Falta revisar también lo que ocurre cuando no hay datos, pues el resultado cambia mucho.""",
    "fr": """La fonction renvoie la valeur de la première colonne et lève une erreur quand l'entrée est vide. Ce n'est pas l'endroit où nous devons changer l'ordre des lignes, car d'autres parties du programme en dépendent. S'il n'y a rien à faire, l'appelant reçoit une liste vide. Il faut vérifier que le fichier existe avant de l'ouvrir, sinon le message serait trompeur. Veuillez vous assurer que les deux arguments ont la même longueur. Il vaudrait mieux garder l'ancien comportement jusqu'à ce que tous les utilisateurs soient passés à la nouvelle version. Seul le dernier élément est utilisé ici, et il doit être plus grand que zéro. Chaque fois que le modèle est ajusté, les résultats précédents sont jetés. Attention : cela peut prendre plusieurs minutes avec beaucoup d'observations. L'utilisateur ne devrait jamais voir ce texte. Que se passe-t-il quand deux tâches écrivent en même temps ? Elles s'attendent l'une l'autre, donc aucune donnée ne peut être perdue. Ne supprimez pas ces lignes, elles sont nécessaires pour les essais. Après la fin de la boucle, nous savons combien de valeurs manquaient. Un nombre absent est remplacé par la moyenne de son groupe, qui a été calculée plus haut. Impossible d'ouvrir la connexion, réessayez plus tard. Il y a trop de paramètres pour si peu de points. Certains d'entre eux peuvent être faux mais cela n'a pas d'importance maintenant. À utiliser seulement si vous savez ce que vous faites. Rien n'a été trouvé sous ce nom. Chaque élément doit apparaître au moins une fois avant que nous puissions continuer. Voir aussi les remarques à la fin de ce fichier pour en savoir plus sur la méthode et ses limites. Combien de temps doit-elle tourner ? Jusqu'à ce que la différence entre un pas et le suivant soit assez petite. La matrice ne peut pas être inversée puisque ses colonnes ne sont pas indépendantes. Je pense que nous pourrions écrire cela plus simplement, pourtant cela marche et c'est rapide.
Nous estimons la variance de l'échantillon à partir des résidus au carré et la divisons par les degrés de liberté. Les poids de toutes les lignes doivent avoir pour somme un, et un poids inférieur à zéro n'est pas permis. Triez d'abord la table par entreprise et par année, car les retards et les différences sont pris au sein de chaque entreprise. La constante est retirée parce que les régresseurs ont déjà été centrés et réduits. Quand le panel est court l'estimateur est biaisé, c'est pourquoi on utilise à sa place un instrument formé de retards plus anciens. Une pente proche de zéro dit peu de chose sur le signe de l'effet. Les erreurs types sont regroupées par cohorte et résistent aux valeurs extrêmes. Il a fallu longtemps pour découvrir pourquoi la courbe était si irrégulière; le noyau et sa largeur de bande avaient été mal choisis. La pénalité garde les coefficients petits, mais elle les éloigne aussi de la vérité. Personne ne sait si cette branche peut encore être atteinte, alors laissez-la comme elle était. Les versions suivantes réutilisent le vecteur que nous gardons ici. Ce chemin est plus lent mais exact, et il donne la même réponse que la formule de l'article. Pensez à fermer le fichier et à libérer la mémoire dès que le dernier bloc a été lu. Le nom d'une variable peut contenir des espaces, et c'est pour cela qu'il doit être mis entre guillemets. On sait très peu de chose sur les valeurs de départ, donc nous en essayons plusieurs et gardons la meilleure. La série possède une racine unitaire et doit être différenciée; autrement le test rejetterait bien trop souvent. Il reste trop peu de points dans cette fenêtre pour calculer un nombre fiable. Si la recherche échoue nous revenons à la règle simple et en donnons la raison au lecteur. Merci à ceux qui ont signalé l'erreur de signe. Vous ne pouvez pas mélanger les deux sortes de dates, même si elles se ressemblent. Ces chiffres ont été vérifiés à la main avec les tables d'un livre imprimé. Les lignes sans réponse sont sautées tandis que les autres comptent deux fois. Le niveau, la tendance et la saison sont mis à jour à chaque étape. Choisissez un nombre entre un et dix, puis appuyez sur la touche pour passer à la question suivante. Cela aurait déjà dû être corrigé; il y a encore une panne chaque fois que la liste n'est pas triée ou qu'elle est vide. Espérons que personne ne l'appelle jamais avec des effectifs négatifs. Le score de chaque unité, la longueur de son dossier et le jour d'entrée sont gardés au même endroit. Il existe une manière encore plus simple, mais elle demande plus de mémoire que n'en ont la plupart des machines. Il reste aussi à vérifier ce qui se passe quand il n'y a pas de données, car le résultat change beaucoup.""",
    "de": """Die Funktion gibt den Wert der ersten Spalte zurück und löst einen Fehler aus, wenn die Eingabe leer ist. Hier darf die Reihenfolge der Zeilen nicht geändert werden, weil andere Teile des Programms davon abhängen. Wenn es nichts zu tun gibt, erhält der Aufrufer eine leere Liste. Wir müssen prüfen, ob die Datei vorhanden ist, bevor sie geöffnet wird, sonst wäre die Meldung verwirrend. Bitte darauf achten, dass beide Argumente gleich lang sind. Es wäre besser, das alte Verhalten zu behalten, bis alle Benutzer auf die neue Version umgestiegen sind. Nur das letzte Element wird hier verwendet, und es muss größer als null sein. Jedes Mal, wenn das Modell angepasst wird, werden die früheren Ergebnisse verworfen. Achtung: das kann bei vielen Beobachtungen mehrere Minuten dauern. Der Benutzer sollte diesen Text nie sehen. Was geschieht, wenn zwei Aufgaben gleichzeitig schreiben? Sie warten aufeinander, also können keine Daten verloren gehen. Diese Zeilen nicht entfernen, sie werden für die Tests gebraucht. Nach dem Ende der Schleife wissen wir, wie viele Werte fehlten. Eine fehlende Zahl wird durch den Mittelwert ihrer Gruppe ersetzt, der oben berechnet wurde. Die Verbindung konnte nicht geöffnet werden, bitte später noch einmal versuchen. Es gibt zu viele Parameter für so wenige Punkte. Einige davon könnten falsch sein, aber das ist jetzt nicht wichtig. Nur benutzen, wenn man weiß, was man tut. Unter diesem Namen wurde nichts gefunden. Jeder Eintrag muss mindestens einmal vorkommen, bevor wir weitermachen können. Siehe auch die Hinweise am Ende dieser Datei, um mehr über das Verfahren und seine Grenzen zu erfahren. Wie lange soll es laufen? Bis der Unterschied zwischen einem Schritt und dem nächsten klein genug ist. Die Matrix lässt sich nicht invertieren, da ihre Spalten nicht unabhängig sind. Ich glaube, wir könnten das einfacher schreiben, es läuft jedoch und ist schnell.
Wir schätzen die Varianz der Stichprobe aus den quadrierten Residuen und teilen sie durch die Freiheitsgrade. Die Gewichte aller Zeilen müssen sich zu eins addieren, und ein Gewicht unter null ist nicht erlaubt. Die Tabelle zuerst nach Firma und Jahr sortieren, denn Verzögerungen und Differenzen werden innerhalb jeder Firma gebildet. Die Konstante fällt weg, weil die Regressoren bereits zentriert und skaliert worden sind. Wenn das Panel kurz ist, wird der Schätzer verzerrt, deshalb nimmt man stattdessen ein Instrument aus älteren Verzögerungen. Eine Steigung nahe null sagt wenig über das Vorzeichen des Effekts. Die Standardfehler werden nach Kohorten gruppiert und sind robust gegen Ausreißer. Es dauerte lange, bis klar war, warum die Kurve so rau aussah; der Kern und seine Bandbreite waren schlecht gewählt. Der Strafterm hält die Koeffizienten klein, aber er entfernt sie auch von der Wahrheit. Niemand weiß, ob dieser Zweig noch erreicht werden kann, also soll er so bleiben wie er war. Spätere Versionen verwenden den Vektor, den wir hier aufheben. Dieser Weg ist langsamer, aber genau, und er liefert dieselbe Antwort wie die Formel im Aufsatz. Nicht vergessen, die Datei zu schließen und den Speicher freizugeben, sobald der letzte Block gelesen ist. Der Name einer Variablen darf Leerzeichen enthalten, darum steht er in Anführungszeichen. Über die Startwerte weiß man sehr wenig, daher versuchen wir mehrere und behalten den besten davon. Die Reihe hat eine Einheitswurzel und muss differenziert werden; sonst würde der Test viel zu oft ablehnen. In diesem Fenster bleiben zu wenige Punkte übrig, um eine verlässliche Zahl zu berechnen. Falls die Suche scheitert, kehren wir zur einfachen Regel zurück und nennen dem Leser den Grund. Danke an alle, die das falsche Vorzeichen gemeldet haben. Die beiden Arten von Daten dürfen nicht gemischt werden, auch wenn sie sich ähnlich sehen. Diese Zahlen wurden von Hand mit den Tafeln eines gedruckten Buches verglichen. Zeilen ohne Antwort werden übersprungen, während die anderen doppelt zählen. Niveau, Trend und Saison werden bei jedem Schritt erneuert. Bitte eine Zahl zwischen eins und zehn wählen, danach die Taste drücken, damit es mit der nächsten Frage weitergeht. Das hätte schon längst behoben werden sollen; es bricht noch immer ab, wenn die Liste nicht sortiert oder leer ist. Hoffentlich ruft das nie jemand mit negativen Anzahlen auf. Die Punktzahl jeder Einheit, die Länge ihres Eintrags und der Tag des Zugangs stehen an einer Stelle. Es gibt einen noch einfacheren Weg, er braucht jedoch mehr Speicher, als die meisten Rechner haben. Außerdem ist noch zu prüfen, was geschieht, wenn keine Daten da sind, denn dann ändert sich das Ergebnis stark.""",
}

CODE_SEED = """
let mut total = 0.0; for i in 0..n { total += x[i] * w[i]; } if count > 0 { return Ok(total / count as f64); }
pub fn solve(a: &Array2<f64>, b: &[f64]) -> Result<Vec<f64>, String> { let k = a.ncols(); match lu(a) { Some(m) => m.solve(b), None => Err(e) } }
impl<'a> Iterator for Rows<'a> { type Item = f64; fn next(&mut self) -> Option<Self::Item> { self.data.get(self.pos).copied() } }
use std::collections::HashMap; const MAX: usize = 100; println!("{:>8.3} {}", a, b); assert_eq!(x.len(), y.len()); vec.push(item);
def fit(self, x, y=None): self.beta = np.linalg.solve(x.T @ x, x.T @ y); return self
import os, sys; from math import sqrt; for row in rows: out.append(row[0]); if not out: raise ValueError("x"); print(f"{a} {b}")
while i < len(v) and v[i] != None: i += 1; try: f = open(path, "r") except IOError as e: pass
SELECT id, name, count(*) FROM table_a WHERE x > 0 GROUP BY id, name ORDER BY name LIMIT 10; INSERT INTO t (a, b) VALUES (1, 2); UPDATE t SET a = 1 WHERE id = 3; SELECT a, b, c FROM t INNER JOIN u ON t.id = u.id AND u.x IS NOT NULL;
y ~ x1 + C(id) + I(x^2) %Y-%m-%d %H:%M:%S https://example.invalid/path/file.csv data/file.csv utf-8 SPDX-License-Identifier: MIT OR Apache-2.0 #[cfg(test)] #![allow(dead_code)] # noqa: E501 # type: ignore eslint-disable cargo build --release python -m pytest
{"key": "value", "list": [1, 2, 3], "flag": true, "none": null} <div class="row"><a href="x.html">x</a></div>
"""
