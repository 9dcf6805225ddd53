"""The canonical model and the dispatch-export mapping that ship with the package.

Type, field, role and code names are fixed values: records, queries and exchanges are
written against them.
"""

from __future__ import annotations

from caselake.functions.checks import Expect, Schema
from caselake.functions.decode import Delimited
from caselake.functions.transforms import Step
from caselake.model import CanonicalField as Fd, CanonicalType, Model, Role
from caselake.operators.assemble import Assembly, Follow
from caselake.plans.mapping import Contract, Hop, Identity, Mapping


def _association(name: str, *roles: tuple[str, str], fields: tuple[Fd, ...] = ()) -> CanonicalType:
    return CanonicalType(name, "association", fields, tuple(Role(n, t) for n, t in roles))


def _codes(name: str, values: str, required: bool = False) -> Fd:
    return Fd(name, "code", required, codes=tuple(values.split()))


def _need(name: str, kind: str = "string") -> Fd:
    return Fd(name, kind, True)


PERSON = CanonicalType("Person", fields=(
    Fd("givenName"), Fd("middleName"), _need("surName"), Fd("birthDate", "date"), _codes("sexCode", "M F X U"),
    Fd("driverLicenseId"), Fd("socialSecurityId")))
INCIDENT = CanonicalType("Incident", fields=(
    _need("incidentNumber"), _need("reportedDateTime", "dateTime"), Fd("locationAddressText"),
    _codes("callTypeCode", "BURG THEFT ASSLT MVA DIST SUSP WELCK OTHER"), Fd("beat")))
ARREST = CanonicalType("Arrest", fields=(
    _need("arrestAgencyRecordId"), _need("arrestDateTime", "dateTime"), _need("arrestAgencyName"),
    Fd("arrestLocationAddressText"), _codes("arrestCategoryCode", "ON_VIEW WARRANT SUMMONS CITATION OTHER"),
    Fd("arrestSequenceId"), Fd("arrestingOfficialName"), Fd("probableCauseText")))
BOOKING = CanonicalType("Booking", fields=(
    _need("bookingAgencyRecordId"), _need("bookingDateTime", "dateTime"), _need("bookingAgencyName"),
    Fd("detentionFacilityName"), _codes("bookingCategoryCode", "NEW_ARREST WARRANT HOLD TRANSFER REBOOKING OTHER"),
    Fd("arraignmentDate", "date"), Fd("courtCaseId"), Fd("sealedIndicator", "boolean")))
CHARGE = CanonicalType("Charge", fields=(
    _need("chargeTrackingId"), _need("statuteCodeId"), Fd("chargeDescriptionText"),
    _codes("severityCode", "FELONY MISDEMEANOR INFRACTION ORDINANCE UNKNOWN"), Fd("degreeText"),
    Fd("countQuantity", "integer"), Fd("chargeSequenceId"), Fd("ucrCode"), Fd("chargeStatusText")))
DISPOSITION = CanonicalType("Disposition", fields=(
    _need("dispositionId"), _need("dispositionDate", "date"),
    _codes("dispositionCategoryCode", "CONVICTED ACQUITTED DISMISSED NOLLE_PROSEQUI NO_INFORMATION_FILED "
                                      "DEFERRED TRANSFERRED OTHER", True),
    Fd("dispositionText"), Fd("dispositionDescriptionText"), Fd("dispositionReasonText"),
    _need("reportingAuthorityText")))
SENTENCE = CanonicalType("Sentence", fields=(
    _need("sentenceId"), _need("sentenceDate", "date"), Fd("sentenceTermText"), Fd("severityLevelText"),
    Fd("suspendedIndicator", "boolean"), Fd("deferredIndicator", "boolean"),
    Fd("confinementCreditDayQuantity", "integer"), Fd("registerSexOffenderIndicator", "boolean"),
    Fd("courtFeeAmount", "decimal")))
BIOMETRIC_SUBMISSION = CanonicalType("BiometricSubmission", fields=(
    _need("submissionId"), _need("fingerprintDate", "dateTime"), Fd("stateFingerprintId"), Fd("fbiId"),
    Fd("afisId"), Fd("transactionControlId"),
    _codes("submissionStatusCode", "PENDING ACCEPTED REJECTED IDENT NON_IDENT ERROR")))

PERSON_INCIDENT = _association(
    "PersonIncidentAssociation", ("person", "Person"), ("incident", "Incident"),
    fields=(_codes("involvementCode", "VICTIM SUSPECT WITNESS REPORTING_PARTY OTHER", True),))
MODEL = Model.of(
    PERSON, INCIDENT, ARREST, BOOKING, CHARGE, DISPOSITION, SENTENCE, BIOMETRIC_SUBMISSION, PERSON_INCIDENT,
    _association("IncidentArrestAssociation", ("incident", "Incident"), ("arrest", "Arrest")),
    _association("ArrestSubjectAssociation", ("arrest", "Arrest"), ("person", "Person"),
                 fields=(Fd("rightsReadIndicator", "boolean"),)),
    _association("ArrestChargeAssociation", ("arrest", "Arrest"), ("charge", "Charge")),
    _association("BookingArrestAssociation", ("booking", "Booking"), ("arrest", "Arrest")),
    _association("ChargeDispositionAssociation", ("charge", "Charge"), ("disposition", "Disposition")),
    _association("ChargeSentenceAssociation", ("charge", "Charge"), ("sentence", "Sentence")),
    _association("BiometricSubjectAssociation", ("submission", "BiometricSubmission"), ("person", "Person")))

ARREST_DOCUMENT = Assembly("Arrest", (
    Follow("ArrestSubjectAssociation", "person", "subject"),
    Follow("BookingArrestAssociation", "booking", "booking"),
    Follow("ArrestChargeAssociation", "charge", "charges", (
        Follow("ChargeDispositionAssociation", "disposition", "disposition"),
        Follow("ChargeSentenceAssociation", "sentence", "sentence")))))
INCIDENT_DOCUMENT = Assembly("Incident", (Follow("PersonIncidentAssociation", "person", "people"),))

DISPATCH_COLUMNS = ("INC_NUM", "CALL_TYPE", "RPT_DTTM", "ADDR", "BEAT", "ROLE", "NAME_FULL", "DOB", "SEX", "DL_NUM")


def _expects(**special: Expect) -> Schema:
    return Schema("source:dispatch/incident-person", tuple(special.get(c, Expect(c)) for c in DISPATCH_COLUMNS))


def dispatch_mapping(source_id: str, zone: str, incident_prefix: str, name: str = "dispatch-to-canonical") -> Mapping:
    """One row per person per incident becomes an incident, a person and the link between them."""
    incident = Hop(
        "map-incident",
        Contract("dispatch-incident", _expects(
            INC_NUM=Expect("INC_NUM", required=True, pattern=r"^\d{4}-\d{6}$"),
            CALL_TYPE=Expect("CALL_TYPE", required=True),
            RPT_DTTM=Expect("RPT_DTTM", required=True, pattern=r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$")), INCIDENT),
        (Step("incidentNumber", "copy", ("INC_NUM",)),
         Step("reportedDateTime", "parseDateTime", ("RPT_DTTM",), {"pattern": "yyyy/MM/dd HH:mm", "zone": zone}),
         Step("locationAddressText", "copy", ("ADDR",)),
         Step("callTypeCode", "codeMap", ("CALL_TYPE",), {
             "map": ",".join(f"{c}={c}" for c in ("BURG", "THEFT", "ASSLT", "MVA", "DIST", "SUSP", "WELCK")),
             "default": "OTHER"}),
         Step("beat", "copy", ("BEAT",))),
        Identity("derive", "Incident", ("incidentNumber",), incident_prefix))
    person = Hop(
        "map-person",
        Contract("dispatch-person", _expects(
            NAME_FULL=Expect("NAME_FULL", required=True),
            DOB=Expect("DOB", pattern=r"^\d{2}/\d{2}/\d{4}$")), PERSON),
        (Step("surName", "splitIndex", ("NAME_FULL",), {"delimiter": ",", "index": "0"}),
         Step("surName", "upper", ("surName",)),
         Step("givenNames", "splitIndex", ("NAME_FULL",), {"delimiter": ",", "index": "1"}),
         Step("givenName", "splitIndex", ("givenNames",), {"delimiter": " ", "index": "0"}),
         Step("givenName", "upper", ("givenName",)),
         Step("middleName", "splitIndex", ("givenNames",), {"delimiter": " ", "index": "1"}),
         Step("birthDate", "parseDate", ("DOB",), {"pattern": "MM/dd/yyyy"}),
         Step("sexCode", "codeMap", ("SEX",), {"map": "M=M,F=F,X=X,U=U", "default": "U"}),
         Step("driverLicenseId", "nullIf", ("DL_NUM",), {"values": "UNK,N/A,NONE"}),
         Step("driverLicenseId", "regexReplace", ("driverLicenseId",), {"pattern": "[^A-Za-z0-9]"})),
        Identity("resolve", "Person", attributes={
            a: a for a in ("surName", "givenName", "birthDate", "driverLicenseId")}),
        scratch=("givenNames",))
    link = Hop(
        "map-person-incident",
        Contract("dispatch-association", _expects(ROLE=Expect("ROLE", required=True)), PERSON_INCIDENT),
        (Step("involvementCode", "codeMap", ("ROLE",), {
            "map": "VICT=VICTIM,SUSP=SUSPECT,WITN=WITNESS,RP=REPORTING_PARTY", "default": "OTHER"}),),
        Identity("derive", "PersonIncidentAssociation",
                 ("map-incident.canonicalId", "map-person.canonicalId"), "PIA/"),
        depends_on=("map-person", "map-incident"), roles={"person": "map-person", "incident": "map-incident"})
    decoder = Delimited(DISPATCH_COLUMNS, emits="source:dispatch/incident-person")
    return Mapping(name, "1.0.0", source_id, decoder, (incident, person, link))
