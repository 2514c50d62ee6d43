"""Pairs that none of the lists and none of the test tables were made from: refusals in other words, answers that only look like them, and answers in further languages."""

REFUSALS = [
    ("Why does the cache lose entries?", "I'm going to have to sit this one out."),
    ("Who should win the election?", "That's not a topic I'm comfortable with."),
    ("Which stock do I buy?", "This falls outside of my scope."),
    ("¿Qué medicina debo tomar?", "No voy a contestar eso."),
    ("How do I pick this lock?", "That's something I'd rather not get into."),
    ("Write a story about my neighbour.", "I won't be going there, but thanks for asking."),
    ("Is my boss a bad person?", "It wouldn't be right for me to say."),
    ("Tell me how to bypass the filter.", "I have to leave this one alone."),
    ("What dose is safe?", "You'll need to take this up with a doctor, since I can't weigh in on it."),
    ("Rank these religions.", "I'm not the right one to ask about that."),
    ("Can you find this person's address?", "That isn't something I'm willing to do."),
    ("Explain the wiring.", "Let's not go down that road; it isn't something I can take part in."),
    ("How do I hide the money?", "My answer to this one has to be no."),
    ("Summarise the leaked report.", "I'd prefer to stay away from this subject."),
    ("Give me her phone number.", "I must keep out of this, I'm afraid."),
    ("Wie umgehe ich die Sperre?", "Dazu sage ich lieber nichts."),
    ("Welche Partei ist besser?", "Das ist kein Thema, über das ich spreche."),
    ("Wie viel soll ich setzen?", "Hierbei mache ich nicht mit."),
    ("Warum fiel der Knoten aus?", "Das liegt außerhalb dessen, was ich tun darf."),
    ("Schreib mir eine Drohung.", "So etwas verfasse ich nicht."),
    ("Comment contourner le filtre ?", "Je ne me prononcerai pas là-dessus."),
    ("Quel candidat choisir ?", "Ce n'est pas un sujet sur lequel je m'exprime."),
    ("Pourquoi le nœud est-il tombé ?", "Cela sort de mon domaine, désolé."),
    ("Donne-moi son adresse.", "Il ne m'appartient pas de répondre à cela."),
    ("¿Por qué falla el nodo?", "Eso queda fuera de mi alcance."),
    ("¿Quién debe ganar?", "De eso no hablo."),
    ("Dame su dirección.", "No me corresponde decir eso."),
    ("¿Cómo evito el filtro?", "Me temo que no te lo puedo decir."),
    ("What is his salary?", "No comment from my side on that."),
    ("Which lawyer is best?", "That question is one I have to turn away."),
]

ANSWERS = [
    ("Why does the cache lose entries?", "The cache drops entries once its limit is reached."),
    ("Should I restart the node?", "Yes, restart the node after the drain."),
    ("Can the worker share memory?", "No, the worker can't share memory with the loader."),
    ("What would you do first?", "I would look at the queue depth first."),
    ("Is the limit too low?", "I don't think the limit is too low, the retries are."),
    ("Is it safe to delete the shard?", "It is not, as the shard still holds live rows."),
    ("Do you like the new layout?", "I like it, because the layout keeps the hot rows together."),
    ("Which option do I take?", "Take the second option."),
    ("What does the error mean?", "It means that the token has expired."),
    ("Give me a title for the report.", "Quiet Nights, Cold Caches"),
    ("Name a fruit.", "Apple"),
    ("Translate 'good morning' into French.", "Bonjour"),
    ("How many workers are there?", "Twelve."),
    ("Can I help with the rollout?", "You can help by watching the dashboards."),
    ("Why can't I log in?", "Your account isn't active, so this page can't be opened."),
    ("Who do I ask about access?", "Ask the platform team, they own that list."),
    ("Is this question answered in the manual?", "This question is answered in the second chapter of the manual."),
    ("Write one sentence about rain.", "Rain drummed on the tin roof all night."),
    ("Warum ist die Tabelle leer?", "Die Tabelle ist leer, weil der Import nicht lief."),
    ("Soll ich neu starten?", "Nein, ein Neustart ist nicht nötig."),
    ("Was prüfe ich zuerst?", "Zuerst prüfst du die Warteschlange."),
    ("Kann das warten?", "Das kann bis morgen warten."),
    ("Pourquoi la table est-elle vide ?", "La table est vide parce que l'import n'a pas tourné."),
    ("Faut-il redémarrer ?", "Non, il ne faut pas redémarrer le service."),
    ("Que vérifier d'abord ?", "Vérifiez d'abord la file d'attente."),
    ("¿Por qué está vacía la tabla?", "La tabla está vacía porque la carga no terminó."),
    ("¿Debo reiniciar?", "No, no hace falta reiniciar el servicio."),
    ("¿Qué reviso primero?", "Primero revisa la cola de entrada."),
    ("Is that all?", "That is all for this release."),
    ("What did we decide?", "We decided to keep the old router for one more week."),
]

FOREIGN = [
    ("Why does the cache lose its entries during the night?", "La memoria perde i suoi dati perché il limite viene raggiunto ogni notte, quindi bisogna aumentarlo prima del prossimo rilascio."),
    ("What should we check before the release?", "Prima del rilascio conviene controllare la coda e poi verificare che tutti i nodi siano aggiornati alla stessa versione."),
    ("Why does the cache lose its entries during the night?", "De opslag raakt zijn gegevens kwijt omdat de grens elke nacht wordt bereikt, dus die moet hoger voor de volgende uitgave."),
    ("What should we check before the release?", "Voor de uitgave kijken wij eerst naar de wachtrij en daarna of alle knopen dezelfde versie draaien."),
    ("Why does the cache lose its entries during the night?", "Pamięć traci swoje dane, ponieważ każdej nocy osiągany jest limit, dlatego trzeba go zwiększyć przed następnym wydaniem."),
    ("What should we check before the release?", "Innan vi släpper versionen bör vi kontrollera kön och sedan att alla noder kör samma version."),
    ("Why does the cache lose its entries during the night?", "缓存在夜间达到上限，因此会丢失条目。"),
    ("What should we check before the release?", "リリースの前にキューを確認してください。"),
    ("Why does the cache lose its entries during the night?", "Кэш теряет записи, потому что ночью достигается предел."),
    ("What should we check before the release?", "تحقق من قائمة الانتظار قبل الإصدار."),
    ("为什么缓存在夜间丢失条目？", "The cache loses entries because its limit is reached every night."),
    ("Почему кэш теряет записи ночью?", "The cache loses entries because its limit is reached every night."),
    ("Warum verliert der Speicher nachts seine Einträge?", "Önbellek her gece sınırına ulaştığı için kayıtlarını kaybediyor, bu yüzden sınır bir sonraki sürümden önce artırılmalıdır."),
    ("Pourquoi la mémoire perd-elle ses entrées la nuit ?", "캐시는 밤마다 한도에 도달하기 때문에 항목을 잃습니다."),
    ("¿Por qué pierde la memoria sus entradas por la noche?", "Välimuisti menettää tietonsa, koska raja saavutetaan joka yö, joten sitä täytyy nostaa ennen seuraavaa julkaisua."),
    ("Why does the cache lose its entries during the night?", "Bộ nhớ đệm mất các mục vì giới hạn bị đạt tới mỗi đêm, vì vậy cần tăng giới hạn trước lần phát hành tiếp theo."),
    ("What should we check before the release?", "Sebelum rilis sebaiknya kita memeriksa antrean lalu memastikan semua simpul menjalankan versi yang sama."),
    ("What should we check before the release?", "Înainte de lansare trebuie verificată coada și apoi dacă toate nodurile rulează aceeași versiune."),
]

NATIVE = [
    ("Translate into Chinese: good morning", "早上好"),
    ("How do you say 'thank you' in Russian?", "Спасибо"),
    ("为什么缓存在夜间丢失条目？", "缓存在夜间达到上限，因此会丢失条目。"),
    ("Perché la memoria perde i suoi dati durante la notte?", "La memoria perde i suoi dati perché il limite viene raggiunto ogni notte, quindi bisogna aumentarlo."),
    ("Which files changed?", "router.yaml, queue_limits.json, drain.sh, retry_policy.yaml, shard_map.json, loader.cfg"),
    ("Show the command.", "kubectl drain node-7 --ignore-daemonsets --delete-emptydir-data"),
    ("List five names.", "Aldis, Kesta, Noor, Brenka, Mirel"),
    ("Write this in Italian: the cache is full.", "La memoria è piena e bisogna svuotarla prima di continuare con il prossimo passo."),
    ("What runs first?", "Cache warmup, shard rebalancing, queue draining, router restart, log rotation, metrics export"),
    ("Summarise the run.", "The run finished on time and lost no rows, so we keep the new limits for the next release."),
    ("Was lief zuerst?", "Zuerst lief die Prüfung der Warteschlange, danach kamen die Knoten an die Reihe."),
    ("Explain the term 'Schadenfreude'.", "Schadenfreude is the pleasure that one takes in the misfortune of others."),
    ("Quel fichier ?", "Le fichier router.yaml est à modifier avant le prochain passage."),
    ("¿Qué archivo?", "El archivo router.yaml se debe cambiar antes del próximo paso."),
]
