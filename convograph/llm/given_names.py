"""Given names and their short forms."""
from __future__ import annotations

import unicodedata
from functools import lru_cache

# Common given names with the short forms they are known by.
SHORT_FORMS = """
Alexander: Alex Xander Sasha Sandy Lex
Amparo: Amparito
Anastasia: Nastya Stasia Ana Tasia
Andrew: Andy Drew
Anthony: Tony
Beatriz: Bea Trixie Betty
Benjamin: Ben Benny
Björn: Bjarne
Catherine: Cathy Cate
Charles: Charlie Chuck
Chidera: Dera Chi
Christopher: Chris Kit Topher
Daniel: Dan Danny
David: Dave Davey
Dmitri: Dima Mitya
Dolores: Lola Lolita
Dorothy: Dot Dottie
Édouard: Ed Eddie Doudou
Edward: Eddie Ned Ted
Ekaterina: Katya Katia
Elizabeth: Liz Beth Betty Lizzie Eliza Libby
Emeka: Meka
Farida: Fari Rida
Francisco: Paco Pancho Fran Curro
Friedrich: Fritz Fred Friedel
Gabriela: Gabi Gaby
Giuseppe: Beppe Pino Peppe Pippo
Guadalupe: Lupe Lupita
Haruka: Haru
Henrietta: Etta Hettie Hetty Henny
Henry: Harry Hank
Ignacio: Nacho
Inés: Nesi
Ingrid: Inga Inge
James: Jim Jimmy Jamie
Johannes: Hannes Hans Jo
John: Jack Johnny
Jonathan: Jon Jonny Nathan
Jürgen: Jogi
Katherine: Kate Kathy Katie Kit Kitty
Kwabena: Kobi Kobina
Leonard: Leo Len Lenny
Lucía: Lucy Luci
Margaret: Peg Meg Maggie Peggy Margie Greta
Mary: Molly Polly
Michael: Mike Mick Mickey Mikey
Nicholas: Nick Nicky
Nikolai: Kolya Nick Niko
Oleander: Ollie Olly
Patricia: Pat Trish Patty Tricia Patsy
Philippa: Pippa Pip
Quillon: Quill
Rashida: Shida Rash
Rebecca: Becky Becca
Renée: Nene
Richard: Rick Dick Richie
Robert: Bob Rob Bobby Robbie Bert
Samantha: Sam Sammy Mantha
Samuel: Sammy
Susan: Sue Susie
Søren: Sören
Thandiwe: Thandi Thandie
Theodore: Ted Theo Teddy
Thomas: Tom Tommy
Ulrike: Ulli Ulla Rike
Valentina: Tina Val Valya
Victoria: Vicky Tori Vic Vicki Vickie
Wanjiru: Ciru Shiru
William: Bill Will Liam Billy Willy
Ximena: Mena Xime
Yusuke: Yu Yuu
Zachary: Zach Zak Zack
Zoë: Zo
"""
# Further given names that are common in the countries of the languages read here. Names that are common words as well are left out.
COMMON = """
Abdullah Abigail Adam Adriana Agnieszka Ahmed Aisha Akira Alejandro Aleksandra Ali Alice Amélie Amina Anders Andrea Andrei Anita Anna Anton Antonio Arjun
Arturo Astrid Barbara Bartosz Bernd Birgit Boris Brigitte Camila Carlos Carmen Carolina Cecilia Chiara Chinedu Claire Claudia Clara Cristina Deepak Denise Diego
Dieter Dominik Elena Emil Emily Emma Enrique Erik Esther Eva Fabian Fatima Felipe Fernando Florian Franz Frederik Gareth Georg Gerhard Gonzalo Grzegorz Guillermo
Gustavo Hannah Hans Hassan Heike Heinz Helena Helga Hiroshi Hugo Ibrahim Igor Irina Isabel Isabella Ivan Jakob Jana Javier Jennifer Jessica Joana Joaquim Jorge José
Juan Juliette Karim Karin Karl Katarzyna Kenji Khadija Klaus Krzysztof Lars Laura Leila Lena Léa Lorenzo Louise Luca Lucas Ludmila Luis Luisa Magdalena Manuel Marcelo Marco
Margarita María Marie Mario Marta Martin Martina Mateo Matthias Maximilian Mehmet Miguel Mikhail Mohamed Mohammed Monika Mustafa Nadia Natalia Nathalie Nikita Nina Noah
Olga Oliver Olivia Omar Oscar Pablo Paolo Pascal Patrick Paul Paulo Pavel Pedro Peter Petra Philipp Pierre Piotr Priya Rafael Rahul Ramón Ricardo Roberto Rodrigo Rosa Sabine
Sakura Salma Sandra Santiago Sara Sebastian Sergei Sergio Silvia Simon Sofia Sonja Stefan Svetlana Takeshi Tatiana Teresa Ursula Vladimir Wei Werner Wolfgang Xavier Yasmin Yuki Yusuf
"""
# Titles before a name.
TITLES = "mr mrs ms miss dr prof professor sir herr frau mme mlle señor señora sr sra sig dott".split()
# Particles between a given and a family name.
PARTICLES = "von van de del della di da do dos das la le der den ten al el bin ibn".split()


def plain(word: str) -> str:
    """Lower case without accents; the Nordic and German letters that take no accent apart."""
    s = unicodedata.normalize("NFKD", word.lower()).replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in s if not unicodedata.combining(c))


@lru_cache(1)
def known_given() -> frozenset[str]:
    """All listed given names and short forms in plain letters."""
    return frozenset(map(plain, COMMON.split())) | frozenset(short_forms())


@lru_cache(1)
def short_forms() -> dict[str, frozenset[str]]:
    """Plain form of a name or short form: the plain full names it may stand for."""
    out: dict[str, set[str]] = {}
    for line in SHORT_FORMS.strip().splitlines():
        full, _, shorts = line.partition(":")
        for x in [full, *shorts.split()]:
            out.setdefault(plain(x), set()).add(plain(full))
            # umlauts are often written out
            spelled = plain(x.lower().replace("ö", "oe").replace("ü", "ue").replace("ä", "ae").replace("ø", "oe"))
            out.setdefault(spelled, set()).add(plain(full))
    return {k: frozenset(v) for k, v in out.items()}
