"""Inspected examples that name the components of the quality mixture."""

# Fixed values: (class, text). Texts written for this purpose after looking at pages of each kind.
EXAMPLES = [
    ("prose", "The choir met on Friday evening and sang for an hour. After that the members talked about the trip to the coast, which had been put off twice. Nobody wanted to wait any longer."),
    ("prose", "A bus that had been ordered for the school arrived two days late. The driver said that the road was closed, so he took the long way around the lake. The children did not mind at all.\nIn the end everybody was home before dark, and the teachers were glad that it was over."),
    ("prose", "Der Chor traf sich am Freitag und sang eine Stunde lang. Danach sprachen die Mitglieder über die Reise an die Küste, die schon zweimal verschoben worden war. Niemand wollte noch länger warten."),
    ("prose", "Das Rathaus bleibt in der nächsten Woche geschlossen, weil die Fenster erneuert werden. Wer einen Ausweis braucht, kann ihn im Bürgerbüro am Markt abholen."),
    ("prose", "La chorale s’est réunie vendredi soir et a chanté pendant une heure. Ensuite, les membres ont parlé du voyage sur la côte, qui avait été reporté deux fois. Personne ne voulait attendre plus longtemps."),
    ("prose", "El coro se reunió el viernes por la tarde y cantó durante una hora. Después, los miembros hablaron del viaje a la costa, que se había aplazado dos veces. Nadie quería esperar más."),
    ("prose", "O coro reuniu-se na sexta-feira à noite e cantou durante uma hora. Depois, os membros falaram da viagem à costa, que tinha sido adiada duas vezes. Ninguém queria esperar mais."),
    ("prose", "Il coro si è riunito venerdì sera e ha cantato per un’ora. Poi i membri hanno parlato del viaggio sulla costa, che era stato rinviato due volte. Nessuno voleva aspettare ancora."),
    ("prose", "Хор собрался в пятницу вечером и пел целый час. Потом участники говорили о поездке на побережье, которую уже дважды переносили. Никто не хотел больше ждать."),
    ("prose", "Школьный автобус опоздал на два дня. Водитель сказал, что дорога была закрыта, и он поехал вокруг озера. Дети совсем не возражали."),
    ("prose", "The walk starts at the church and follows the river for six miles. Bring water, because there is no shop on the way.\n- the upper bridge, Marlow\n- the old quarry near Denby\nMost people need about three hours. That is all."),
    ("prose", "La promenade commence à l’église et suit la rivière pendant dix kilomètres. Il faut emporter de l’eau, car il n’y a pas de magasin en route.\n- le pont du haut, Marly\n- la vieille carrière près de Denain\nVoilà tout."),
    ("prose", "Хор собрался в пятницу вечером и пел целый час.\n– тише едешь –\nПотом участники говорили о поездке на побережье, которую уже дважды переносили. Никто не хотел больше ждать.\nДругие сообщения о хоре"),
    ("prose", "Школьный автобус опоздал на два дня. Водитель сказал, что дорога была закрыта\nДети совсем не возражали. Все вернулись домой до темноты.\n- новый мост, Карино\n- старая мельница near Долгово"),
    ("prose", "Il coro si è riunito venerdì sera e ha cantato per un’ora.\nLeggi anche il viaggio sulla costa\nPoi i membri hanno parlato della gita, che era stata rinviata due volte. Nessuno voleva aspettare"),
    ("list", "• apples\n• 2 kg pears\n• jam Larosu\n• tea, 12 box\n• Molina\n• 3 pcs soap\n• blue ink\n• Tasami\n• green wool, 14 m\n• 9 l milk"),
    ("list", "* apples, 15 g\n* jam\n* 4 box tea\n* Borena\n* soap Kalimo\n* ink\n* 22 m rope\n* pears\n* milk, 5 l"),
    ("list", "- grey stones\n- Pomela\n- 7 set tiles\n- яблоки, 4 kg\n- Seife\n- lait\n- jabón Mureta\n- wooden pegs\n- 16 pcs cups"),
    ("list", "1. pears, 3 kg\n2. Lorani\n3. 5 box tea\n4. soap Vendala\n5. grey stones\n6. ink, 2 l\n7. яблоки\n8. cups"),
    ("list", "1) tiles\n2) 6 m rope\n3) Parento\n4) jam, 11 set\n5) tea Mirola\n6) milk\n7) Seife, 8 pcs\n8) green wool"),
    ("list", "[ ] tea\n[ ] 3 kg pears\n[ ] jam, 4 l\n[ ] Dorami\n[ ] soap\n[ ] 10 pcs cups\n[ ] ink Selano\n[ ] tiles"),
    ("list", "apples Nareti\nsoap, 3 pcs\nLomina\n5 g ink\ngreen wool\n12 set tiles\npears\nmilk Tarosi\nrope, 9 m\ntea"),
    ("list", "• apples, • 4 kg pears, • jam Larosu, • tea, 9 box, • Molina, • soap, • ink, • 3 m rope, • tiles, • cups Serano"),
    ("list", "1. apples, 2. 4 kg pears, 3. jam Larosu, 4. tea, 9 box, 5. Molina, 6. soap, 7. ink, 8. 3 m rope, 9. tiles"),
    ("list", "The choir met on Friday evening and sang for an hour.\n• apples\n• 2 kg pears\n• jam Larosu\n• tea, 12 box\n• Molina\n• 3 pcs soap\n• blue ink\n• Tasami\n• green wool, 14 m\n• cups\n• rope\n• 7 set tiles"),
    ("list", "Der Chor traf sich am Freitag und sang eine Stunde lang.\n1. pears, 3 kg\n2. Lorani\n3. 5 box tea\n4. soap Vendala\n5. grey stones\n6. ink, 2 l\n7. яблоки\n8. cups\n9. rope\n10. tiles, 4 m"),
    ("list", "The choir met on Friday evening and sang for an hour.\n• apples, • 4 kg pears, • jam Larosu, • tea, 9 box, • Molina, • soap, • ink, • 3 m rope, • tiles, • cups Serano, • grey stones, • milk"),
    ("list", "El coro se reunió el viernes por la tarde y cantó durante una hora.\n1. apples, 2. 4 kg pears, 3. jam Larosu, 4. tea, 9 box, 5. Molina, 6. soap, 7. ink, 8. 3 m rope, 9. tiles, 10. cups, 11. milk"),
    ("list", "La chorale s’est réunie vendredi soir et a chanté pendant une heure.\n[ ] apples, [ ] 4 kg pears, [ ] jam Larosu, [ ] tea, 9 box, [ ] Molina, [ ] soap, [ ] ink, [ ] 3 m rope, [ ] tiles, [ ] cups"),
    ("list", "apples, 4 kg pears, jam Larosu, tea, 9 box, Molina, soap, ink, 3 m rope, tiles, cups Serano, grey stones, milk, 14 set pegs, Doreli"),
    ("list", "* apples no. seramo\n* 4 kg pears ref seramox\n* jam Larosu id seramoxx\n* tea, 9 box seramoxxx\n* Molina #seramoxxxx\n* soap id seramoxxxxx\n* ink, 2 l ref seramoxxxxxx\n* tiles no. seramoxxxxxxx"),
    ("list", "1. apples ref seramo\n2. 4 kg pears #seramox\n3. jam Larosu id seramoxx\n4. tea, 9 box seramoxxx\n5. Molina no. seramoxxxx\n6. soap seramoxxxxx\n7. ink, 2 l ref seramoxxxxxx"),
    ("table", "name\tyear\tsum\tcode\napples\t2021\t44.10\t883\nMolina\t-\t7.2%\t9120\n5521\t2020-03-04\t310\t-\ntea\t12.5%\t-\t04.05.2019"),
    ("table", "name | year | sum | code\napples | 2021 | 44.10 | 883\nMolina | - | 7.2% | 9120\n5521 | 2020-03-04 | 310 | -\ntea | 12.5% | - | 04.05.2019"),
    ("table", "name ¦ year ¦ sum\napples ¦ 2021 ¦ 44.10\nMolina ¦ - ¦ 7.2%\n5521 ¦ 2020-03-04 ¦ 310\ntea ¦ 12.5% ¦ 8121"),
    ("table", "name, year, sum, code, place\napples, 2021, 44.10, 883, -\nMolina, -, 7.2%, 9120, 3/7/2020\n5521, 2020-03-04, 310, -, 77\ntea, 12.5%, -, 04.05.2019, 9"),
    ("table", "name;year;sum\napples;2021;44.10\nMolina;-;7.2%\n5521;2020-03-04;310\ntea;12.5%;8121"),
    ("table", "name  year  sum  code\napples  2021  44.10  883\nMolina  -  7.2%  9120\n5521  2020-03-04  310  -\ntea  12.5%  -  04.05.2019"),
    ("table", "The choir met on Friday evening and sang for an hour.\nname\tyear\tsum\tcode\napples\t2021\t44.10\t883\nMolina\t-\t7.2%\t9120\n5521\t2020-03-04\t310\t-\ntea\t12.5%\t-\t04.05.2019\n77\t8.1%\t612\t-"),
    ("junk", "2023-02-11 04:12:09 INFO [sofare] code=201 ms=512\n2023-02-11 04:12:11 WARN [nalimo] code=404 ms=77\n2023-02-12 16:40:58 ERROR [parena] code=500 ms=9120"),
    ("junk", "var rosa=function(a,b){return a[3]||b.lima(77);};\n.sorena{margin:4px;color:#a1b2c3;padding:1em}\nvar lote=function(a,b){return a[0]||b.pira(12);};"),
    ("junk", "function run(x){if(x>3){return x*2;}else{return null;}}\nfor(var i=0;i<10;i++){out[i]=run(i);}\nif(!out){throw new Error('x');}"),
    ("junk", "#$%^ &*(@ !~_+ {}|: <>?/ \\=-` ;:%$ #@!* ^&_+ |}{ ~`=- $$%^ *&^% /\\|< >>=+ _~!@ #$%& *-+= :;<> |\\/^ &%$# @!~_ +=-*"),
    ("junk", "q7fk2 9zmx4v p0 h8w3r}t k{2j vn5b6 ~x9c 4lq8s7d zz1 g6|p w0e3r5 t7y bn2m4 kx8 {a9s d3f} 5gh j1k~ l0p o9i8 u7y6 t5"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q/bm90aGluZyB0byBzZWU+aGVyZQx9Kz3vQm8tYWJj\nZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXoxMjM0NTY3ODkwQUJDREVGR0hJSktMTU5PUA=="),
    ("junk", "Ã¼ber Ã¤n â€™st ï¿½ Ð¸Ñ xxxx Ã©Ã¨ â€œ Â» ��n Ã¶st xxer ï¿½n Ã¤er ��� Ð¾Ñ Â» xxxxxst Ã¼n â€™er Ã©Ã¨n"),
    ("prose", "Our teacher walked to the station in the rain, and the train had already left when she came. She waited for the next one in the small café and read the paper from the day before"),
    ("prose", "The letters lay in a box under the stairs for forty years. Nobody had asked for them, and nobody knew who had written them, until the house was sold\nThe new owners gave them to the library, where they can be read on weekdays."),
    ("prose", "Quand la pluie a cessé, les enfants sont sortis dans la cour et ont joué jusqu’au soir. Leur grand-mère les regardait par la fenêtre de la cuisine, une tasse de thé à la main\nLe lendemain, tout le village parlait de la crue."),
    ("prose", "La nonna ha preparato il pane come ogni sabato, e i vicini sono venuti a prenderlo prima di mezzogiorno. Poi si sono seduti tutti insieme all’ombra del fico e hanno parlato della vendemmia"),
    ("prose", "Als der Zug endlich kam, war es schon dunkel, und die meisten Leute waren nach Hause gegangen. Der Schaffner entschuldigte sich bei allen, die noch da waren, und ließ sie ohne Fahrkarte einsteigen"),
    ("prose", "El barco salió del puerto con dos horas de retraso porque faltaba el cocinero. Nadie se quejó, pues todos sabían que sin él la travesía sería muy larga\nAl final llegaron de noche, con hambre y de buen humor."),
    ("junk", "&^%$ #@!* ~~|| <>?: {}[] =+=- _-_ %%%% ^^^^ ;;:: **&& ((%) $#$ @@!! ~^~ |_| <<>> ??!! +-+-\n#$%^ &*() _+|~ {}:? ><><"),
    ("junk", "*** /// ### === +++ --- @@@ $$$ ||| ~~~ <<< >>> %%% ^^^ &&& ___ \\\\\\ !!! ;;; ::: ((( ))) [[[ ]]]"),
]
