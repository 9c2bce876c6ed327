"""Texts written by hand with their pieces of personal information; names and sentences are none of the labelled table's."""

CASES = [
    ("Priya Raghunathan and Tunde Bakare flew in last night.", [("name", "Priya Raghunathan"), ("name", "Tunde Bakare")]),
    ("A speech by Abraham Lincoln was read aloud.", [("name", "Abraham Lincoln")]),
    ("Dr. Ngozi Okonjo-Iweala chairs the board.", [("name", "Ngozi Okonjo-Iweala")]),
    ("Please copy jane.doe+news@mail.example.co.uk on that.", [("email", "jane.doe+news@mail.example.co.uk")]),
    ("Passport no. X1234567 and IBAN DE89 3704 0044 0532 0130 00 are on file.", [("id_number", "X1234567"), ("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("Elle habite Rue de la Paix 14, au fond de la cour.", [("address", "Rue de la Paix 14")]),
    ("The York Times crossword took an hour.", []),
    ("Did Guillermo Bustamante send you the minutes?", [("name", "Guillermo Bustamante")]),
    ("Mrs Wilhelmina Achterberg runs the shop downstairs.", [("name", "Wilhelmina Achterberg")]),
    ("yours faithfully, Thaddeus Q. Pomeroy", [("name", "Thaddeus Q. Pomeroy")]),
    ("We interviewed Saoirse O'Brannigan for the podcast.", [("name", "Saoirse O'Brannigan")]),
    ("Attendance: Hollingsworth, Beatrix; nobody else.", [("name", "Hollingsworth, Beatrix")]),
    ("Credit goes to F. Zimmerlin for the idea.", [("name", "F. Zimmerlin")]),
    ("My dentist Xiomara Quintanilla is moving away.", [("name", "Xiomara Quintanilla")]),
    ("Congratulations to Bartholomew Finch-Hatton on the prize!", [("name", "Bartholomew Finch-Hatton")]),
    ("ever since zebulon featherstone left, the choir sounds thin", [("name", "zebulon featherstone")]),
    ("Signed: EUPHEMIA WATERFORD", [("name", "EUPHEMIA WATERFORD")]),
    ("You can get hold of me through kestrel_99@birdwatch.org any time.", [("email", "kestrel_99@birdwatch.org")]),
    ("billing queries go to accounts-payable@northwind-traders.com", [("email", "accounts-payable@northwind-traders.com")]),
    ("drop a line: hortense [at] lighthouse [dot] net", [("email", "hortense [at] lighthouse [dot] net")]),
    ("my mail used to be t.w.anderson@uni-kassel.de back then", [("email", "t.w.anderson@uni-kassel.de")]),
    ("SUPPORT@ACMEWIDGETS.COM never replied", [("email", "SUPPORT@ACMEWIDGETS.COM")]),
    ("ask zoe at sunflower dot org about it", [("email", "zoe at sunflower dot org")]),
    ("Give grandma a buzz, she is on 0161 496 0821 these days.", [("phone", "0161 496 0821")]),
    ("The garage answered at (503) 555-0147 in the end.", [("phone", "(503) 555-0147")]),
    ("emergency contact +61 2 5550 1234", [("phone", "+61 2 5550 1234")]),
    ("fax number 030/1234567 is dead", [("phone", "030/1234567")]),
    ("hotline: 1-800-555-0199 ext. 42, nobody picks up", [("phone", "1-800-555-0199 ext. 42")]),
    ("mon portable: 06 12 34 56 78 si besoin", [("phone", "06 12 34 56 78")]),
    ("give me a shout, 07911 123456", [("phone", "07911 123456")]),
    ("the number's +4915112345678, she says", [("phone", "+4915112345678")]),
    ("HR needs your social security number, mine is 219-09-9999.", [("id_number", "219-09-9999")]),
    ("my NI number: AB 12 34 56 C", [("id_number", "AB 12 34 56 C")]),
    ("her driving licence MORGA657054SM9IJ ran out", [("id_number", "MORGA657054SM9IJ")]),
    ("DNI 12345678Z, copy attached", [("id_number", "12345678Z")]),
    ("identity card 592.41.08-331.27? that looks off", [("id_number", "592.41.08-331.27")]),
    ("transfer it to IBAN FR76 3000 6000 0112 3456 7890 189 by noon", [("id_number", "FR76 3000 6000 0112 3456 7890 189")]),
    ("passport C01X00T47 was stolen", [("id_number", "C01X00T47")]),
    ("He still lives at 1600 Pennsylvania Avenue, so they say.", [("address", "1600 Pennsylvania Avenue")]),
    ("the bakery moved to 12b Cowley Mews last spring", [("address", "12b Cowley Mews")]),
    ("send the kettle back to 77 Massachusetts Ave, Apt 5", [("address", "77 Massachusetts Ave, Apt 5")]),
    ("Treffpunkt: Schillerstraße 9 um acht", [("address", "Schillerstraße 9")]),
    ("vivo en Calle de Serrano 21 desde marzo", [("address", "Calle de Serrano 21")]),
    ("post it to P.O. Box 8813, it is safer", [("address", "P.O. Box 8813")]),
    ("I grew up at 4 Privet Drive in a cupboard", [("address", "4 Privet Drive")]),
    ("Unit 7, 45 Tannery Lane has a leaking roof", [("address", "Unit 7, 45 Tannery Lane")]),
    ("The release notes for version 14.2.0 mention 1,204 fixes.", []),
    ("Tracking 1Z999AA10123456784 says delivered on 2023-11-05.", []),
    ("Best Picture went to The Quiet Harbour this year.", []),
    ("Our flight LH 4071 leaves gate B22 at 17:45.", []),
    ("I paid 1,299.00 for 3 chairs and 12 cushions.", []),
    ("@morning_lark @old_owl42 see https://birds.example.test/9912 #owls", []),
    ("Grace under pressure is a rare thing, said the coach.", []),
    ("Chapter 12: The Long Road Home", []),
    ("Will you mark the tests by Friday?", []),
    ("GDP grew 2.3% in 2021 and 1.9% in 2022.", []),
    ("The meeting is in Room 404 on the fourth floor.", []),
    ("Add 250 g flour, 125 ml milk and 2 eggs.", []),
    ("MONDAY NIGHT FOOTBALL IS BACK", []),
    ("Set x to 0.0025 and run 10000 steps.", []),
    ("Rose told Mark about it.", []),
    ("Isolde baked a cake for the whole office.", []),
    ("Professor Plimpton was late again.", []),
    ("call Ottoline Vandersteen on 555-867-5309 or ottoline@vandersteen.dev", [("name", "Ottoline Vandersteen"), ("phone", "555-867-5309"), ("email", "ottoline@vandersteen.dev")]),
    ("Cornelius Abernathy, 9 Juniper Hollow Road, 0131 496 0550", [("name", "Cornelius Abernathy"), ("address", "9 Juniper Hollow Road"), ("phone", "0131 496 0550")]),
]

#: A second set, written when the first had been looked at.
CASES += [
    ('I owe Marguerite Delacroix a postcard.', [('name', 'Marguerite Delacroix')]),
    ('the eulogy for Harold Pennington was short', [('name', 'Harold Pennington')]),
    ('Minutes taken by: Soledad Iturralde', [('name', 'Soledad Iturralde')]),
    ('Captain Elspeth MacAllister retired in May', [('name', 'Elspeth MacAllister')]),
    ('Hi, this is Desmond Achebe from the library', [('name', 'Desmond Achebe')]),
    ('Regards\nPhilippa Throckmorton', [('name', 'Philippa Throckmorton')]),
    ('Our tutor, Ignatius B. Fairweather, is ill', [('name', 'Ignatius B. Fairweather')]),
    ('tickets for Valentina Kozlova please', [('name', 'Valentina Kozlova')]),
    ('dear mr okonkwo', []),
    ("you'll find me at bramble.fox@gmail.com", [('email', 'bramble.fox@gmail.com')]),
    ('unsubscribe via no-reply@newsletter.shop.io', [('email', 'no-reply@newsletter.shop.io')]),
    ('cc: theo_92@yahoo.co.in and ops@infra.net', [('email', 'theo_92@yahoo.co.in'), ('email', 'ops@infra.net')]),
    ('mail lotte(at)web(dot)de', [('email', 'lotte(at)web(dot)de')]),
    ('my cell is 415-555-2671', [('phone', '415-555-2671')]),
    ('dial 0800 123 4567 for the helpline', [('phone', '0800 123 4567')]),
    ('bel me op 06-12345678', [('phone', '06-12345678')]),
    ('sms to +254 712 345678', [('phone', '+254 712 345678')]),
    ('Telefon (030) 901820', [('phone', '(030) 901820')]),
    ('office 212.555.0188 x12', [('phone', '212.555.0188 x12')]),
    ('SSN on file: 078-05-1120', [('id_number', '078-05-1120')]),
    ('passport number 533401234', [('id_number', '533401234')]),
    ('IBAN: GB29NWBK60161331926819', [('id_number', 'GB29NWBK60161331926819')]),
    ('NIE X1234567L caducado', [('id_number', 'X1234567L')]),
    ('her national insurance number is JG103759A', [('id_number', 'JG103759A')]),
    ('we rent a room at 221B Baker Street', [('address', '221B Baker Street')]),
    ('Lieferung an Hauptstr. 5 bitte', [('address', 'Hauptstr. 5')]),
    ("dinner's at 18 Rue Saint-Denis", [('address', '18 Rue Saint-Denis')]),
    ('my new place: 3500 Deer Creek Rd, Unit 4', [('address', '3500 Deer Creek Rd, Unit 4')]),
    ('write to PO Box 42', [('address', 'PO Box 42')]),
    ('Via Garibaldi 7 is around the corner', [('address', 'Via Garibaldi 7')]),
    ('Apollo 11 landed in 1969.', []),
    ('Call of Duty sold 30 million copies', []),
    ('Windows 11 build 22621.1702', []),
    ('The Great Gatsby is due on Monday', []),
    ('population 8,336,817 in 2020', []),
    ('Lake Placid hosted in 1932 and 1980', []),
    ('It cost 45.99 at 7:30 pm', []),
    ('GitHub issue 10432 is closed', []),
]
