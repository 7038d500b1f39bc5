"""Sentences written by hand, apart from the operator's training sentences; personal data is marked as {kind|text}."""

SENTENCES = """
You can reach Marta under {email|marta.lindqvist@posteo.example.se} until Friday.
Her old address was {email|m_lindqvist at web dot example dot org}, which no longer works.
Please send the invoice to {email|accounts+may@harbour-works.example.com}; thanks.
Mail {email|otto (at) brew (dot) net} for the recipe.
Our bot answers at {email|help[at]quayside[dot]io} around the clock.
phone {phone|202 555 0143} and ask for Mr Bell
Call {phone|(020) 7946 0958} before noon.
Tel. {phone|+44 20 7946 0958}, fax {phone|+44 20 7946 0959}.
The night desk has the number {phone|+49 (30) 901820}.
You may text {phone|0151-2345678} at any time.
Ring the warden: {phone|555-867-5309}.
Dial {phone|1-800-555-0199} to cancel.
She left her mobile {phone|07700 900 123} with the porter.
The login came from {ip|203.0.113.42} at night.
Block {ip|198.51.100.7} and {ip|198.51.100.23} on the firewall.
He wrote the address as {ip|192[.]0[.]2[.]15} so that nobody would click.
My card {card|4539 1488 0343 6467} was declined twice.
Pay with {card|4539148803436467} or leave it.
The form showed {card|5105-1051-0510-5100} in plain sight.
Card number: {card|3782.8224.6310.005}, they said.
The bridge opened on 12.05.1998 and closed in 2011.
Version 4.12.7 fixes the fault that 4.12.6 had.
In 1904 there were 1,203,400 people in the 31 parishes.
Order 8841297733 left the store on 2021-03-14.
ISBN 978-3-16-148410-0 is out of print.
Lines 120 to 345 of the file were lost.
He ran 42.195 km in 2:03:59 at the age of 31.
The part has the number 6011 0009 9013 9425 9 on its back.
We met at the dot of nine, at the gate.
The tower is 324.75 m high; the mast adds 12 m.
Section {ip|3.2.1.4}.9 lists what the pattern takes for an address.
The sum is 4 210 333 and the rest is 17.
""".strip().splitlines()
