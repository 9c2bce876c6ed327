"""Sentences written by hand, none from the test data: abuse of many forms, and harmless sentences with the same words."""

ABUSIVE = """
I will slit your throat
I'm going to murder your family
you people are animals
fuck off you cunt
immigrants are a plague on this country
wanna see my boobs
im sorry but you are an idiot
I'm telling you, you worthless idiot
you are such a pathetic excuse, you moron
honestly you're a complete imbecile
you absolute scumbag, give it back
he is a total bastard and she knows it
what a bunch of idiots you are
shut your mouth, you ugly pig
you stupid bitch
listen, you spineless coward
you were a disgusting liar back then
oi dickhead, move your car
You are nothing but trash.
you're so dumb
she is such a filthy slut
@jonas_k is an utter moron
the world would be better if you had never been born
people like you make me sick
your kind disgusts us all, makes me want to vomit
you make me sick
waste of oxygen
nobody would miss you, go die
hope you choke
I hope somebody shoots you
I hope your whole family burns
we will hunt you down, we will kill you
i swear i'll stab you
I'm gonna break your legs
somebody should strangle you
you deserve to be shot
you should rot in hell
kill yourself
go hang yourself, freak
I know where you live.
you're dead meat
I'll bash your face in, I'll smash your teeth
watch your back.
a bullet in your head is what you get
all foreigners are scum
those migrants are vermin!
muslims are rats
refugees should be shot
gays should be exterminated
they should be gassed
go back to your own country
go back to where you came from
I hate all immigrants
death to all infidels
kill all jews
women are inferior
immigrants don't belong here
never trust a gypsy
keep those filthy foreigners away from our children
send nudes
show me your tits
I want to fuck you tonight
suck my dick
hot nude pics in my bio
watch me masturbate
free porn here
horny and bored, dm me
let me kiss every inch of your body, I'd lick your thighs
who wants to sext
du bist ein Vollidiot
Du dumme Schlampe
ich bringe dich um
Alle Ausländer sind Abschaum
verpiss dich
schick mir Nacktbilder
eres un imbécil
eres una basura.
te voy a matar
hijo de puta
ojalá te mueras
todos los inmigrantes son ratas
mándame fotos desnuda
tu es un connard
t'es vraiment débile
espèce d'idiot
je vais te tuer
va te faire foutre
tous les migrants sont des parasites
envoie-moi tes nudes
y0u are an id10t
YOU ARE A W.O.R.T.H.L.E.S.S LOSER
you fuuucking moooron
""".strip().splitlines()
HARMLESS = """
your pig is lovely
your trash is out
your fraud claim was approved
you are a snake charmer
watch your back on the ice, grandma
kill yourself laughing
You are an idiot, he said.
"You are a moron," she shouted at the screen.
he wrote that you are a coward in his novel
someone called you an idiot? that is awful
the word idiot comes from Greek
you are not a loser
I would never hurt you
don't hurt yourself
sorry if I hurt you
did I hurt you yesterday
I don't want to kill you with details
I will beat you at chess
we will crush you in the final, good luck
I'll find you a seat
I will find you later at the station
I know where you live now, nice street
she shot a lovely film about refugees
refugees are welcome here
the immigrants are neighbours of ours
immigrants are a blessing for this country
women are engineers too
all whales are animals
those dogs are animals we love
the cockroaches in the lab are insects
pigs are clever animals
rats should be kept in pairs
the plants should be removed from the bed
old posters should be banned from the wall
the disease is a burden on the clinic
cancer is a disease
go back to the village and ask
go back to your seat
I hate all mondays
I hate the rain
death to the old router
keep those dirty boots away from our carpet
kill the process and restart
this knife is dull, cut your onions thin
beat the eggs until fluffy
break a leg tonight
running can hurt your knees
you should burn the candle first
you should hang the coat there
choke the engine before you start
go hang with your friends
the clown was great fun
what a fool believes is a song
April fool
trash day is tomorrow
you lucky dog
you are the best
you're so kind
you are sick, rest well
you look ugly in no dress at all
he is a weasel keeper at the zoo
my dog is a little monster in the garden
the naked mole rat is odd
naked trees in winter
show me your notes
send me your address
send pics of the garden
watch me strip the paint off the door
I want to kiss the bride
touch your screen to start
lick the spoon
hot soup tonight
free hugs
sex education class moved to room four
the nude portrait sold well
he plays cock of the walk
pussy willow branches in a vase
shut up and take my money
shut up, that is amazing
what a waste of time
nobody likes mondays
nobody wants you to fail
you killed it on stage
that joke killed me
I could murder a curry
you are a beast at tennis
du bist ein Schatz
die Hunde sind Tiere
ich bringe dich nach Hause
eres una estrella
te voy a llamar mañana
todos los gatos son animales
tu es un ange
je vais te voir demain
tous les chats sont gris
my dumb phone froze
stupid rain again
an idiot light on the dashboard
""".strip().splitlines()

#: A second set, written when the first had been used for corrections.
ABUSIVE += """
you're a worthless piece of trash
what an absolute moron
you are garbage
you disgusting pervert
go kill yourself
I hope you get cancer
I hope you die in a fire
you are a waste of space
I'm coming to kill you
we're going to burn your house down
I will rape you
someone needs to punch him in the face
you should be hanged
all women are whores
blacks are inferior
jews control everything and should be gassed
those refugees are cockroaches
kick all muslims out
gays are disgusting
deport them all, they are criminals and rapists
these people are subhuman
you fat ugly cow
shut up you stupid idiot
nobody wants you here
eat shit and die
you are dumber than a rock
you make me want to puke
your mother is a whore
he's a complete idiot
she's nothing but a dirty whore
they are all idiots
your family deserves to suffer
I'll cut your throat
I want to see your tits
send me pics of your ass
let's have sex tonight
suck my cock
looking for someone to fuck
hey sexy, want to see me naked?
click here for free nude pics
ich hasse dich, du Hurensohn
du bist so dumm
Ausländer raus
ihr seid alle Idioten
ich werde dich töten
eres un hijo de puta
vete a la mierda
los inmigrantes son escoria
te voy a romper la cara
ferme ta gueule
sale pute
tu es une ordure
les arabes sont des rats
je vais te casser la gueule
k1ll y0urself
f.u.c.k y.o.u
you m0r0n
stfu you clown
die, scum
drop dead
""".strip().splitlines()
HARMLESS += """
the idiot box was on all evening
she wrote a book called The Idiot
my cat killed a mouse
we shot the scene twice
kill two birds with one stone
the movie bombed
this song slaps
I beat my personal record
they crushed the competition
he was hanged in 1820
the colony was exterminated by disease in the novel
trash can lids were stolen
the rat ran under the sofa
dirty dishes everywhere
you look stunning
you are my sunshine
you were right about the pig farm
what a beautiful day you are having
shut the door please
nobody knows you better
go die-cast toys are great
I hope you feel better
I hope you get the job
I will find the book for you
I'm going to kill it tonight on stage
we will destroy the old shed
all lions are predators
those apples are rotten
the plague killed many people
keep those boxes away from our stairs
never trust a skinny chef
go back to sleep
send me the report
show me the way
want to see my garden?
naked singularity theory
free samples
hot pics of lava
du bist mein bester Freund
ich werde dich besuchen
eres muy amable
te voy a ayudar
tu es très gentil
je vais te chercher
the kids are little monsters at bedtime
he calls himself an idiot
don't be stupid about money
that was a stupid mistake of mine
women are paid less
immigrants should be welcomed
refugees are people
muslims are celebrating today
foreigners were happy
he got fired, what a loss
my boss is a jerk seasoning fan
dead people tell no tales
the bitch had five puppies
cock-a-doodle-doo
pussycat dolls concert
sex is determined by chromosomes
""".strip().splitlines()
