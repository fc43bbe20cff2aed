"""Sentences written by hand, not by the generator of the training texts: at least nine in ten of each kind, and nothing in the clean ones."""

import pytest

from surgelight.llm import personal as p

GIVEN = "Maria John Ahmed Li Sofia Peter Anna Carlos Emma David Julia Omar Nina Paul Laura".split()
FAMILY = "Anderson Peterson Robertson Andersen Petersen Robertsen Goldman Goldberg Goldstein Silverman Silverberg Silverstein Blackwood Blackwell Blackburn Hartwell Hartwood Hartman Newman Newell Newburn Lindberg Lindman Lindholm Garcia Smith Khan".split()

FRESH = {
"email": ["the invoice went to billing-dept@northwind.co.uk yesterday", "Ping me: q.li+news@uni-hamburg.de", "forward everything to HELP@SHOP.EXAMPLE please", "my new one is sam99 [at] postbox [dot] org", "reply to sam dot jones at mailbox dot org", "old address tim_o@corp.example bounced", "questions? staff@museum.museum", "cc'd laura.k@dept.uni.edu on that"],
"phone": ["Office line (212) 555-0147, ask for sales", "You can reach the clinic at +49 89 1234567", "fax: 020 7946 0018", "his cell is 415.555.0132", "SMS +91 98765 43210 for the code", "Hotline 0800 123 4567 is free", "dial 1-800-555-0199 now", "my mobile changed to 07911 123456", "phone +34 612 345 678 tomorrow", "tel: +81-3-1234-5678"],
"id_number": ["His SSN, 078-05-1120, leaked", "passport number C01X00T47 expired", "NI number AB 12 34 56 C is on the payslip", "DNI 12345678Z please bring it", "my CPF: 111.444.777-35", "Aadhaar 2345 6789 0123 was rejected", "driver licence MORGA657054SM9IJ", "tax ID 12 345 678 901 on the form", "personnummer 19811218-9876", "NRIC S1234567D at the counter"],
"address": ["We moved to 221B Baker Street last spring", "ship to 1600 Pennsylvania Avenue", "our office: 4 Privet Drive, Little Whinging", "Hauptstraße 15, 10115 Berlin is the venue", "12 rue de Rivoli, 75001 Paris", "calle Mayor 7 in the centre", "P.O. Box 1142, Springfield", "meet outside 77 Sunset Blvd", "the flat is at 9 Elm Court", "send it to Lindenallee 8"],
"name": ["Maria Anderson signed the lease", "we hired John Goldstein today", "Dr Robertson will see you", "thanks, Ahmed Khan!", "according to Blackwell, Emma", "Ms. Hartman called twice", "Regards, Tomasz Kowalczyk", "Prof. Lindholm gave the talk", "Sofia Garcia-Newman wrote this", "Peter Smith and I left"],
}
CLEAN = ["the score was 21-14 in the third", "flight BA 2490 leaves at 10:45", "version 10.15.7 fixes it", "ISBN 0-306-40615-2 in paperback", "order 123-4567890-1234567 shipped", "the 2024-25 budget grew 3.5%", "room 1408, floor 14", "Grand Canyon and Yellow Stone", "the rose garden will open", "IBAN GB82 WEST 1234 5698 7654 32", "meet at noon dot on", "see page 1024 of 2048", "we ran 42 km in 3:15:00", "bus 221 to Baker Station", "error code 0x80070057"]


@pytest.fixture(scope="module")
def names():
    return p.NameList.of([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY])


@pytest.mark.parametrize("kind", FRESH)
def test_kind(names, kind):
    model = p.trained(names)
    found = [{s.kind for s in p.find(x, names, model)} for x in FRESH[kind]]
    assert sum(kind in f for f in found) >= 0.9 * len(found)
    assert sum(bool(f - {kind}) for f in found) <= 0.1 * len(found)


def test_clean(names):
    assert [x for x in CLEAN if p.find(x, names, p.trained(names))] == []
